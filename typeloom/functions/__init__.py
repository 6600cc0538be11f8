"""Column expressions: lexical rules, type mapping, coercion, casting and rendering."""
