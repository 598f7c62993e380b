"""An analytical query library on PySpark: relational operators, dialect functions, sources and sinks as DataFrame plans."""
