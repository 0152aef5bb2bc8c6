"""Jobs made of several operators: base models, stacking, dictionaries."""
