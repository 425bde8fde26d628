"""A PySpark-native engine that turns publisher HTML, article XML and ePub into Markdown, at collection scale."""
