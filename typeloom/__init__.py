"""typeloom: typed migration, audit, change application and export of relational tables on Spark."""
