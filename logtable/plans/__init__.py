"""How work is laid out on the cluster: staged tables and ordered scans."""
