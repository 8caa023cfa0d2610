"""Jobs composed of the operators, and the queries checked against SQL."""
