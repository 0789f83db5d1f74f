"""Price-bar signals, trade outcomes and their statistics as Spark DataFrame operators."""
