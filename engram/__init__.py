"""PySpark-native analytics over a store of short documents."""
