"""Guarded read-only SQL: a statement audit as column expressions, and the
run of an accepted statement over the gold view.

The guard is pure built-in string functions, so a log of millions of
statements is checked as one projection.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values: the guard's words, in the order they are tested. ---
FORBIDDEN_WORDS = ["INSERT", "UPDATE", "DELETE", "DROP", "TRUNCATE", "ALTER", "CREATE",
                   "GRANT", "REVOKE", "pg_"]
DEFAULT_LIMIT = 10
NOT_SELECT_TEXT = "شما فقط مجاز به پرسیدن سوالات تحلیلی (SELECT) هستید."
FORBIDDEN_TEXT = "دستور غیرمجاز شناسایی شد: "
# --- end of fixed values ---


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def clean_fences(c: Column | str) -> Column:
    """Drop ```sql and ``` fences, then trim whitespace at both ends."""
    s = F.replace(F.replace(_c(c), F.lit("```sql"), F.lit("")), F.lit("```"), F.lit(""))
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def _word(word: str) -> str:
    return r"(?i)\b" + re.escape(word) + r"\b"


def guard_sql(statements: DataFrame, col: str = "sql", limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Q1: verdict per statement: ``is_valid``, ``reason`` and the cleaned
    text (LIMIT added when the word is absent).

    Must start with SELECT (any case); the first forbidden word found (whole
    word, any case) rejects; otherwise ``LIMIT n;`` is appended, after
    dropping trailing semicolons, when no whole word LIMIT appears anywhere.
    """
    cleaned = clean_fences(col)
    starts = F.upper(F.substring(cleaned, 1, 6)) == F.lit("SELECT")
    reason = F.when(~starts | cleaned.isNull(), F.lit("not_select"))
    for w in FORBIDDEN_WORDS:
        reason = reason.when(cleaned.rlike(_word(w)), F.lit(f"forbidden:{w}"))
    has_limit = cleaned.rlike(_word("LIMIT"))
    limited = F.when(has_limit, cleaned).otherwise(
        F.concat(F.regexp_replace(cleaned, ";+$", ""), F.lit(f" LIMIT {limit};")))
    out = statements.withColumn("reason", reason)
    return out.select(*statements.columns, F.col("reason").isNull().alias("is_valid"),
                      F.col("reason"),
                      F.when(F.col("reason").isNull(), limited)
                       .otherwise(F.lit("")).alias("sanitized_sql"))


def refusal_text(reason: Column | str) -> Column:
    """The message a refused statement is answered with, by its cause: not a
    SELECT, or the forbidden word that was found."""
    r = _c(reason)
    return (F.when(r == "not_select", F.lit(NOT_SELECT_TEXT))
            .when(r.startswith("forbidden:"), F.concat(F.lit(FORBIDDEN_TEXT), F.substring_index(r, ":", -1))))


def refusals(verdicts: DataFrame) -> DataFrame:
    """Q3 refusals: the refused statements of a guard result, each with the
    message of its cause."""
    return verdicts.where(~F.col("is_valid")).select(
        "stmt_id", "reason", refusal_text("reason").alias("message"))


#: The one relation a statement may read, as the parser names it.
GOLD_TABLE = "[gold, dataset]"
#: Functions a statement may call: what works on the values of its own rows.
ALLOWED_FUNCTIONS = frozenset("""
    count sum avg mean min max median stddev stddev_samp stddev_pop variance var_samp var_pop corr mode
    percentile percentile_cont percentile_approx approx_count_distinct count_if any_value first last max_by min_by
    collect_list collect_set bool_and bool_or every some
    row_number rank dense_rank percent_rank cume_dist ntile lag lead first_value last_value nth_value
    abs ceil ceiling floor round bround sqrt exp ln log log10 log2 pow power mod sign signum greatest least width_bucket
    coalesce nullif nvl nvl2 ifnull if isnan isnull isnotnull
    lower upper lcase ucase trim ltrim rtrim btrim length char_length character_length concat concat_ws substr substring
    left right replace translate lpad rpad split split_part position locate instr initcap reverse contains startswith endswith
    like ilike rlike regexp regexp_like regexp_extract regexp_replace format_number to_char to_number try_to_number
    now current_date current_timestamp localtimestamp date date_trunc trunc date_part datepart extract
    year quarter month week weekofyear day dayofmonth dayofweek dayofyear hour minute second
    date_add date_sub datediff date_diff add_months months_between last_day to_date to_timestamp date_format make_date
    make_interval unix_timestamp timestampadd timestampdiff
    cast try_cast string int bigint double decimal timestamp boolean struct named_struct array size element_at
    not and or between
""".split())
#: Parts of a parsed statement that read nothing but what stands below them.
ALLOWED_PLANS = frozenset("""
    GlobalLimit LocalLimit Offset Sort Project Filter Aggregate Distinct SubqueryAlias Join OneRowRelation
    Union Except Intersect WithWindowDefinition
""".split())
ALLOWED_ANALYSIS = frozenset("""
    UnresolvedRelation UnresolvedFunction UnresolvedAlias UnresolvedAttribute UnresolvedStar UnresolvedExtractValue
    UnresolvedOrdinal UnresolvedHaving UnresolvedInlineTable UnresolvedSubqueryColumnAliases UnresolvedWindowExpression
""".split())
REFLECTION = frozenset({"CallMethodViaReflection", "TryReflect"})
#: Text, quoted names and comments of a statement (left as they are), or the table's name.
_PIECES = re.compile(
    r"""[rR]'[^']*'|[rR]"[^"]*"|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|--[^\n]*|/\*.*?\*/
        |(?P<table>(?<![\w`.])(?:gold|`gold`)\s*\.\s*(?:dataset|`dataset`)(?![\w`]))|`(?:[^`]|``)*`""",
    re.IGNORECASE | re.DOTALL | re.VERBOSE)


def _nodes(part) -> Iterator[dict]:
    """Every node of a parsed statement: plans, expressions and the plans of
    subqueries inside them."""
    if isinstance(part, dict):
        if "class" in part:
            yield part
        for value in part.values():
            yield from _nodes(value)
    elif isinstance(part, list):
        for value in part:
            yield from _nodes(value)


def _refuse(why: str):
    raise PermissionError(f"statement rejected: {why}")


def confined_tables(spark: SparkSession, text: str) -> int:
    """How often a statement names gold.dataset; raises ``PermissionError``
    if anything in it, subqueries included, reads another relation, a file or
    a table function, or calls what isn't in ``ALLOWED_FUNCTIONS``.

    The check is on the parsed statement, before any name is looked up: what
    the session's catalog holds (tables, views, registered functions) plays
    no part, and quoting or comments hide nothing."""
    from pyspark.errors import ParseException
    try:
        parsed = json.loads(spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toJSON())
    except ParseException as e:
        _refuse(f"not one SQL statement ({str(e).splitlines()[0]})")
    tables = 0
    for node in _nodes(parsed):
        package, _, name = node["class"].rpartition(".")
        name = name.rstrip("$")
        if name == "UnresolvedRelation":
            if node["multipartIdentifier"].lower() != GOLD_TABLE:
                _refuse(f"reads {node['multipartIdentifier']}, not only gold.dataset")
            tables += 1
        elif name == "UnresolvedFunction":
            called = node["nameParts"].strip("[]").lower()
            if called not in ALLOWED_FUNCTIONS:
                _refuse(f"calls {called}")
        elif package.endswith("catalyst.expressions") or ".catalyst.expressions." in package:
            if name in REFLECTION:
                _refuse(f"calls {name}")
        elif not (package.endswith("plans.logical") and name in ALLOWED_PLANS
                  or package.endswith("catalyst.analysis") and name in ALLOWED_ANALYSIS):
            _refuse(f"uses {name}")
    return tables


def run_guarded_sql(spark: SparkSession, sql: str, gold: DataFrame) -> DataFrame:
    """Q2: guard one statement, then run it on the gold rows only.

    After the word guard (Q1) the parsed statement is walked with all its
    subqueries (``confined_tables``): it may read gold.dataset and nothing
    else, and call only functions of the allow-list. Then the table's name,
    where it stands as a name and not inside a literal or a comment, is bound
    to the ``gold`` DataFrame. The result is whole.
    """
    verdict = guard_sql(spark.createDataFrame([(sql,)], "sql string")).first()
    if not verdict["is_valid"]:
        _refuse(verdict["reason"])
    text = verdict["sanitized_sql"].rstrip().rstrip(";")
    named = confined_tables(spark, text)
    bound, at = [], 0
    for m in _PIECES.finditer(text):
        if m.group("table"):
            bound += [text[at:m.start()].replace("{", "{{").replace("}", "}}"), "{gold}"]
            at = m.end()
    if bound.count("{gold}") != named:
        _refuse("gold.dataset can't be told from the text around it")
    bound.append(text[at:].replace("{", "{{").replace("}", "}}"))
    return spark.sql("".join(bound), gold=gold) if named else spark.sql(text)


def query_records(df: DataFrame) -> DataFrame:
    """Each result row as one JSON record (field -> value)."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("record"))
