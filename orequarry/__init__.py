"""orequarry: data-mining analytics as plain Spark DataFrame operators."""
