"""Maps the driver's test tables onto the domain tables and registers the checked queries."""
