"""lumencube: cube and catalog analytics expressed as Spark DataFrame plans."""
