"""Column functions: file names, admission rules, text trimming."""
