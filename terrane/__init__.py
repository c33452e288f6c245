"""Field-level Earth-observation analytics, expressed as Spark DataFrame plans."""
