"""flowledger: equipment-catalogue tables cleaned, merged, checked and searched as Spark DataFrames."""
