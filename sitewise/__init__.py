"""Lead and site intelligence as Spark DataFrame transforms."""
