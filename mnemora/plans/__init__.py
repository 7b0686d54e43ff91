"""Named queries over the driver's tables, each with its plain-SQL twin where SQL can express it."""

#: Modules of this package that define QUERIES and SQL.
MODULES = ("general", "scalar", "memory")
