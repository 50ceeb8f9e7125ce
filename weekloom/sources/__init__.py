"""Reading and writing tables, yearly files, fitted parameters and models."""
