"""PySpark-native engine for extractive question answering over document collections and
for analysing how well it answers."""
