"""Every query of the engine by name, with the SQL it is held against."""

from quillmill.plans import corpus, files, language

QUERIES = corpus.QUERIES | language.QUERIES | files.QUERIES
ORACLE_SQL = corpus.ORACLE_SQL | language.ORACLE_SQL | files.ORACLE_SQL
