"""loomtext: a PySpark-native engine for quantitative and qualitative text research."""
