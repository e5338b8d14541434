"""inkledger: a Spark-first engine for reconstructing and auditing roster records.

Everything is a pure ``DataFrame -> DataFrame`` function: sources give typed tables,
``functions`` hold column expressions, ``operators`` hold relational operators, ``plans``
hold the registered queries and their SQL counterparts, ``streaming`` the incremental
versions.  The optional subpackage ``llm`` adds operators for training-data work; nothing
outside it imports it.
"""

__version__ = "0.1.0"
