"""navspark: analytics over daily fund NAVs, as Spark DataFrame plans."""
