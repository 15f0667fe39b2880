"""The registered queries: name, operators covered, Spark query, DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
OPERATORS: dict[str, str] = {}

# SQL of the views in sources/tables.py
FILES = "files AS (SELECT source AS project_id, lang || '/' || source || '/doc_' || doc_id || '.md' AS path, strlen(text)::BIGINT AS size, text, doc_id FROM documents)"
COMMITS = "commits AS (SELECT DISTINCT l_orderkey AS commit_id, 'docs/part_' || l_partkey || '.md' AS path, o_orderdate AS ts FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
CODE = """code AS (SELECT p_partkey AS code_id, 'import { a } from ''./part_' || p_size || '''' || chr(10) || '// rest of file' || chr(10) || 'class P' || p_partkey || ' {' || chr(10) || '  run(' || p_size || ') {' || chr(10)
  || '    // ' || p_name || chr(10) || '    a = ' || p_size || ';' || chr(10) || chr(10) || '    b = a;' || chr(10) || '  }' || chr(10) || '}' || chr(10) || 'const x = { y: ' || p_size || ' };' || chr(10)
  || '# ' || p_brand || chr(10) || 'url = ''http://x/' || p_partkey || '''; // tail' AS text FROM part)"""
REPLIES = """replies AS (SELECT conv_id, turn, 'Here it is.' || chr(10) || f || 'And more:' || chr(10) || f AS text FROM (
  SELECT conv_id, turn, '## File: src/f' || conv_id || '.ts' || chr(10) || '```ts' || chr(10) || text || chr(10) || '```' || chr(10) AS f FROM conversations WHERE role = 'assistant'))"""
EDGES = "edges AS (SELECT project_id, path AS src, lead(path) OVER (PARTITION BY project_id ORDER BY doc_id) AS dst, 'docgraph' AS reason, (doc_id % 11) / 10.0 AS confidence FROM files)"
#: Base candidates of recommendations: the recently committed files (labels.toxic = 1).
BASE = "base AS (SELECT project_id, path, text FROM files JOIN labels USING (doc_id) WHERE toxic = 1)"


def query(name: str, operators: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name], OPERATORS[name] = f, operators
        if sql:
            SQL[name] = sql
        return f

    return register


def base_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.recommend import small
    from ..sources.tables import files, table

    recent = small(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"))  # else all texts would be shuffled once Spark takes the labels' files for large
    return files(spark, sf_dir).join(recent, "doc_id").select("project_id", "path", "text")


def joined(c) -> F.Column:  # noqa: ANN001
    """An array of strings as one string, as both engines print it."""
    return F.array_join(c, "|")


from . import queries_functions, queries_operators, queries_patch, queries_streams  # noqa: E402, F401
