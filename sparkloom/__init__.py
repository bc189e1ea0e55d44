"""sparkloom: spatial-omics analytics expressed as Spark DataFrame plans."""
