"""Plans: operators bound to the tables of the driver."""
