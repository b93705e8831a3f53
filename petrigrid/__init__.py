"""petrigrid: plate-count analytics expressed as Spark DataFrame plans."""
