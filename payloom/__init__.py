"""payloom: accounts-payable document analytics expressed as Spark DataFrame plans."""
