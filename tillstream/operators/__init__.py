"""Receipt operators on DataFrames."""
