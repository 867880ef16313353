"""Profiles, vocabularies and the table encoding both ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions import arrays, scale
from tallyweave.operators import checks, encode, guide, lookups, profile, tables
from tallyweave.queries.registry import query, round_doubles, rounded, table
from tallyweave.session import cut_lineage, scratch

PROFILED = {
    "l_linenumber": "int",
    "l_quantity": "double",
    "l_extendedprice": "double",
    "l_discount": "double",
    "l_returnflag": "string",
}
# Small discounts become "not applicable".
_LINES_SQL = """lines AS (SELECT * REPLACE (CASE WHEN l_discount < 0.02 THEN -8 ELSE l_discount END
    AS l_discount) FROM lineitem)"""


def lines(spark, folder):
    df = table(spark, folder, "lineitem").select(*PROFILED)
    small = F.col("l_discount") < 0.02
    return df.withColumn("l_discount", F.when(small, -8.0).otherwise(F.col("l_discount")))


def _stats_sql(name, kind):
    number = name if kind != "string" else "CAST(NULL AS DOUBLE)"
    return f"""SELECT '{name}' AS "column", '{kind}' AS dtype, count(*) AS n_rows,
        count(*) - count({name}) AS n_null, CAST(min({number}) AS DOUBLE) AS minimum,
        CAST(max({number}) AS DOUBLE) AS maximum,
        CAST(max({number}) - min({number}) AS DOUBLE) AS span,
        round(avg({number}), 6) AS mean, round(stddev_samp({number}), 6) AS std,
        coalesce(bool_or({number} = -8), false) AS has_sentinel,
        count(DISTINCT {name}) + CAST(bool_or({name} IS NULL) AS BIGINT) AS n_distinct FROM lines"""


@query(
    f"WITH {_LINES_SQL} " + " UNION ALL ".join(_stats_sql(n, k) for n, k in PROFILED.items())
)
def column_profile(spark, folder):
    return profile.profile(lines(spark, folder), exact=True).withColumns(
        {"mean": F.round("mean", 6), "std": F.round("std", 6)}
    )


SUMMARISED = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"]


def _summary_sql(c):
    if c == "l_returnflag":
        nothing = "CAST(NULL AS DOUBLE)"
        numbers = ", ".join(
            f"{nothing} AS {n}" for n in ("mean", "std", "minimum", "q25", "q50", "q75", "maximum")
        )
        extremes = f"min({c}) AS least, max({c}) AS greatest"
    else:
        quartiles = ", ".join(
            f"""CAST(list_sort(list({c}))[CAST(floor((count({c}) - 1) * {q / 100} + 0.5) AS BIGINT)
                + 1] AS DOUBLE) AS q{q}"""
            for q in (25, 50, 75)
        )
        numbers = f"""round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
            CAST(min({c}) AS DOUBLE) AS minimum, {quartiles}, CAST(max({c}) AS DOUBLE) AS maximum"""
        extremes = "CAST(NULL AS VARCHAR) AS least, CAST(NULL AS VARCHAR) AS greatest"
    return f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS n_null,
        {numbers}, {extremes} FROM lineitem"""


@query(" UNION ALL ".join(map(_summary_sql, SUMMARISED)))
def summary_stats(spark, folder):
    found = profile.summary(table(spark, folder, "lineitem"), SUMMARISED)
    return found.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(
    """SELECT 'c_custkey' AS "column" FROM customer HAVING count(DISTINCT c_custkey) = count(*)
    UNION ALL SELECT 'c_name' FROM customer HAVING count(DISTINCT c_name) = count(*)
    UNION ALL SELECT 'c_nationkey' FROM customer HAVING count(DISTINCT c_nationkey) = count(*)
    UNION ALL SELECT 'c_mktsegment' FROM customer HAVING count(DISTINCT c_mktsegment) = count(*)"""
)
def identifier_columns(spark, folder):
    """Columns with a different value in every row."""
    columns = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    profiled = profile.profile(table(spark, folder, "customer"), columns, exact=True)
    return profile.identifier_like(profiled).select("column")


@query(
    f"WITH {_LINES_SQL} "
    + " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", CASE WHEN {"true" if k == "string" else "false"}
            OR coalesce(bool_or(CAST({n} AS VARCHAR) IN ('-8', '-8.0')), false)
            OR count(DISTINCT {n}) + CAST(bool_or({n} IS NULL) AS INTEGER) < 25
            THEN 'categorical' ELSE 'continuous' END AS kind FROM lines"""
        for n, k in PROFILED.items()
    )
)
def infer_kinds(spark, folder):
    return encode.infer_kinds(lines(spark, folder))


WORDS = {"lineitem": ["l_returnflag", "l_linenumber", "l_tax"], "part": ["p_brand", "p_size", "p_name"]}


def _words_sql(columns, source):
    counted = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY {c} NULLS FIRST) - 1 AS INTEGER)
            AS token, CAST({c} AS VARCHAR) AS value, n FROM
            (SELECT {c}, count(*) AS n FROM {source} GROUP BY {c})"""
        for c in columns
    )
    return f"""SELECT "column", token, value, n,
        round(avg(n) OVER (PARTITION BY "column") / n, 9) AS weight FROM ({counted})"""


@query(
    _words_sql(WORDS["lineitem"], "lineitem") + " UNION ALL " + _words_sql(WORDS["part"], "part")
)
def vocabulary(spark, folder):
    found = [encode.vocabulary(table(spark, folder, t), c) for t, c in WORDS.items()]
    return round_doubles(found[0].union(found[1]))


@query(
    f"""SELECT "column", round(avg(weight), 9) AS mean_weight,
        round(sum(weight * n) / sum(n), 9) AS counted_mean_weight
    FROM ({_words_sql(WORDS["part"], "part")}) GROUP BY "column" """
)
def category_weights(spark, folder):
    """The plain mean weight depends on the column, the count-weighted mean is 1."""
    words = encode.vocabulary(table(spark, folder, "part"), WORDS["part"])
    return round_doubles(
        words.groupBy("column").agg(
            rounded(F.avg(rounded("weight"))).alias("mean_weight"),
            rounded(F.sum(rounded("weight") * F.col("n")) / F.sum("n")).alias("counted_mean_weight"),
        )
    )


def _rank_sql(column, source):
    return f"(SELECT {column}, CAST(row_number() OVER (ORDER BY {column}) - 1 AS INTEGER) AS token FROM (SELECT DISTINCT {column} FROM {source}))"


def _part_plan(spark, folder):
    parts = table(spark, folder, "part")
    columns = ["p_brand", "p_type", "p_size", "p_name"]
    return parts, encode.fit(parts, include=columns, overrides={c: "categorical" for c in columns})


@query(
    f"""SELECT p_partkey, b.token AS p_brand, t.token AS p_type, s.token AS p_size, n.token AS p_name
    FROM part JOIN {_rank_sql("p_brand", "part")} b USING (p_brand)
    JOIN {_rank_sql("p_type", "part")} t USING (p_type)
    JOIN {_rank_sql("p_size", "part")} s USING (p_size)
    JOIN {_rank_sql("p_name", "part")} n USING (p_name)"""
)
def tokenise(spark, folder):
    parts, plan = _part_plan(spark, folder)
    return encode.encode(parts, plan, keep=["p_partkey"])


@query(
    f"""SELECT p_partkey, coalesce(t.token, -1) AS p_type FROM part
    LEFT JOIN {_rank_sql("p_type", "(SELECT * FROM part WHERE p_size <= 25 AND p_type <> 'PROMO')")} t USING (p_type)"""
)
def tokenise_unseen(spark, folder):
    """Encoding all parts with the vocabulary of some: unknown types become -1."""
    parts = table(spark, folder, "part")
    known = parts.where((F.col("p_size") <= 25) & (F.col("p_type") != "PROMO"))
    plan = encode.fit(known, include=["p_type"])
    return encode.encode(parts, plan, keep=["p_partkey"], unseen="code")


@query(
    """SELECT 'p_name' AS "column", p_name AS value, count(*) AS n FROM part
    WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_type <> 'PROMO' AND p_size <= 2)
    GROUP BY p_name"""
)
def unseen_values(spark, folder):
    parts = table(spark, folder, "part")
    known = parts.where((F.col("p_size") <= 2) & (F.col("p_type") != "PROMO"))
    return encode.unseen_values(parts, encode.fit(known, include=["p_name"]))


@query("SELECT p_partkey, p_brand, p_type, p_size, p_name FROM part")
def detokenise(spark, folder):
    parts, plan = _part_plan(spark, folder)
    tokens = encode.encode(parts, plan, keep=["p_partkey"])
    return encode.decode(tokens, plan, keep=["p_partkey"])


@query(
    """SELECT o_orderkey, round((o_totalprice - (SELECT min(o_totalprice) FROM orders))
        / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders), 9) AS o_totalprice FROM orders"""
)
def minmax(spark, folder):
    orders = table(spark, folder, "orders")
    plan = encode.fit(orders, include=["o_totalprice"])
    return round_doubles(encode.encode(orders, plan, keep=["o_orderkey"]))


@query("SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders")
def minmax_inverse(spark, folder):
    orders = table(spark, folder, "orders")
    plan = encode.fit(orders, include=["o_totalprice"])
    scaled = encode.encode(orders, plan, keep=["o_orderkey"])
    decoded = encode.decode(scaled, plan, keep=["o_orderkey"])
    return decoded.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query(
    """SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute,
        round((hour(ts) * 60 + minute(ts)) / 1440.0::DOUBLE, 9) AS share FROM events"""
)
def time_cycle(spark, folder):
    """Minute of the day as a share of the day, and back from it."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    events = table(spark, folder, "events").select("event_id", minute.alias("minute"))
    share = scale.cycle_scale(F.col("minute"))
    return events.select(
        "event_id",
        scale.cycle_unscale(share, "int").alias("minute"),
        rounded(share).alias("share"),
    )


@query(
    f"""SELECT p_partkey, t.token AS p_brand FROM part
    JOIN {_rank_sql("p_brand", "part")} t USING (p_brand)"""
)
def encode_one_column(spark, folder):
    parts, plan = _part_plan(spark, folder)
    return encode.encode_column(parts, plan, "p_brand", keep=["p_partkey"])


ENCODED = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_tax"]


def _line_plan(spark, folder):
    df = table(spark, folder, "lineitem")
    return df, encode.fit(df, include=ENCODED, overrides={"l_quantity": "continuous"})


@query(
    f"""SELECT l_orderkey, f.token AS l_returnflag, s.token AS l_linestatus, m.token AS l_linenumber,
        round((l_quantity - (SELECT min(l_quantity) FROM lineitem))
            / (SELECT max(l_quantity) - min(l_quantity) FROM lineitem), 9) AS l_quantity,
        t.token AS l_tax
    FROM lineitem JOIN {_rank_sql("l_returnflag", "lineitem")} f USING (l_returnflag)
    JOIN {_rank_sql("l_linestatus", "lineitem")} s USING (l_linestatus)
    JOIN {_rank_sql("l_linenumber", "lineitem")} m USING (l_linenumber)
    JOIN {_rank_sql("l_tax", "lineitem")} t USING (l_tax)"""
)
def encode_table(spark, folder):
    df, plan = _line_plan(spark, folder)
    return round_doubles(encode.encode(df, plan, keep=["l_orderkey"]))


@query(
    f"""WITH kinds(c, kind, dtype) AS (VALUES ('l_returnflag', 'categorical', 'string'),
        ('l_linestatus', 'categorical', 'string'), ('l_linenumber', 'categorical', 'int'),
        ('l_quantity', 'continuous', 'double'), ('l_tax', 'categorical', 'double')),
    sizes AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, count(DISTINCT {c}) AS n, CAST(min({c}) AS VARCHAR) AS low FROM lineitem" for c in ENCODED)})
    SELECT c AS "column", kind, dtype,
        CAST(CASE kind WHEN 'categorical' THEN n ELSE 1 END AS INTEGER) AS size,
        CASE kind WHEN 'continuous' THEN CAST(low AS DOUBLE) END AS minimum
    FROM kinds JOIN sizes USING (c)"""
)
def encoding_plan(spark, folder):
    _, plan = _line_plan(spark, folder)
    return plan.frame(spark).select("column", "kind", "dtype", "size", "minimum")


@query(f"SELECT l_orderkey, {', '.join(ENCODED)} FROM lineitem")
def decode_roundtrip(spark, folder):
    df, plan = _line_plan(spark, folder)
    numbers = encode.encode(df, plan, keep=["l_orderkey"])
    decoded = encode.decode(numbers, plan, keep=["l_orderkey"])
    return decoded.withColumn("l_quantity", rounded("l_quantity"))


WIDE = ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"]


def _wide_lines(spark, folder):
    df = table(spark, folder, "lineitem").select(*WIDE, "l_linenumber", "l_returnflag")
    return df, encode.fit(df, include=WIDE, overrides={c: "categorical" for c in WIDE})


@query(
    f"""SELECT l_linenumber, l_returnflag, {", ".join(f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}" for c in WIDE)}
    FROM lineitem"""
)
def tokenise_wide(spark, folder):
    """Several columns of many values each, as if none could be broadcast."""
    df, plan = _wide_lines(spark, folder)
    return encode.encode(df, plan, keep=["l_linenumber", "l_returnflag"], broadcast_rows=0)


@query(f"SELECT l_linenumber, l_returnflag, {', '.join(WIDE)} FROM lineitem")
def detokenise_wide(spark, folder):
    """The same there and back."""
    df, plan = _wide_lines(spark, folder)
    keep = ["l_linenumber", "l_returnflag"]
    tokens = encode.encode(df, plan, keep=keep, broadcast_rows=0)
    return encode.decode(tokens, plan, keep=keep, broadcast_rows=0)


# Shares of each return flag given the line status, one array per line status.
_FLAG_SQL = """flags AS (SELECT l_returnflag, CAST(row_number() OVER (ORDER BY l_returnflag) - 1 AS INTEGER)
        AS token FROM (SELECT DISTINCT l_returnflag FROM lineitem)),
    statuses AS (SELECT DISTINCT l_linestatus FROM lineitem),
    probs AS (SELECT s.l_linestatus, f.l_returnflag, f.token, coalesce(c.n, 0)
            / sum(coalesce(c.n, 0)) OVER (PARTITION BY s.l_linestatus)::DOUBLE AS p
        FROM statuses s CROSS JOIN flags f LEFT JOIN (SELECT l_linestatus, l_returnflag, count(*) AS n
            FROM lineitem GROUP BY ALL) c
        ON c.l_linestatus = s.l_linestatus AND c.l_returnflag = f.l_returnflag)"""


def flag_probabilities(spark, folder):
    """The plan of the return flag and ``l_linestatus, p_l_returnflag``, written once."""
    df = table(spark, folder, "lineitem").select("l_linestatus", "l_returnflag")
    plan = encode.fit(df, include=["l_returnflag"])
    tokens = encode.encode(df, plan, keep=["l_linestatus"])
    n = plan["l_returnflag"].size
    counts = [F.count_if(F.col("l_returnflag") == k) for k in range(n)]
    given = tokens.groupBy("l_linestatus").agg(
        F.array(*[c / F.count(F.lit(1)) for c in counts]).alias("p_l_returnflag"),
        F.count(F.lit(1)).alias("n"),
    )
    return plan, cut_lineage(given)


# The same for every status of an order; one that no line has takes the shares of all lines.
_ORDER_FLAG_SQL = _FLAG_SQL.replace("probs AS", "of_lines AS") + """,
    every AS (SELECT l_returnflag, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM lineitem GROUP BY 1),
    probs AS (SELECT s.o_orderstatus AS l_linestatus, f.l_returnflag, f.token, coalesce(c.p, e.share) AS p
        FROM (SELECT DISTINCT o_orderstatus FROM orders) s CROSS JOIN flags f JOIN every e USING (l_returnflag)
        LEFT JOIN of_lines c ON c.l_linestatus = s.o_orderstatus AND c.token = f.token)"""


@query(
    f"""WITH {_ORDER_FLAG_SQL} SELECT o_orderkey, o_orderstatus, l_returnflag
    FROM orders JOIN (SELECT l_linestatus, arg_min(l_returnflag, (-p, token)) AS l_returnflag
        FROM probs GROUP BY l_linestatus) ON o_orderstatus = l_linestatus"""
)
def argmax_decode(spark, folder):
    """The most likely return flag of each order by its status."""
    plan, given = flag_probabilities(spark, folder)
    rows = _orders_with(spark, folder, given)
    return encode.decode_probabilities(rows, plan, keep=["o_orderkey", "o_orderstatus"])


def _orders_with(spark, folder, given):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", F.col("o_orderstatus").alias("l_linestatus")
    )
    found = lookups.look_up(orders, given.drop("n"), "l_linestatus")
    # A status that no line has takes the shares of all lines.
    places = given.select("n", F.posexplode("p_l_returnflag").alias("token", "p"))
    shares = places.groupBy("token").agg((F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("p"))
    every = shares.agg(F.sort_array(F.collect_list(F.struct("token", "p"))).alias("s"))
    every = every.select(F.transform("s", lambda s: s["p"])).scalar()
    return found.withColumn("p_l_returnflag", F.coalesce("p_l_returnflag", every))


_MULTINOMIAL_SQL = f"""WITH {_ORDER_FLAG_SQL}, running AS (SELECT *, sum(p) OVER (PARTITION BY l_linestatus ORDER BY token
            ROWS UNBOUNDED PRECEDING) AS upto, sum(p) OVER (PARTITION BY l_linestatus ORDER BY token
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total,
            count(*) OVER (PARTITION BY l_linestatus) AS k FROM probs),
    drawn AS (SELECT o_orderkey, o_orderstatus, ('0x' || substr(md5('7:l_returnflag:' || o_orderkey), 1, 8))
            ::UBIGINT / 4294967296.0::DOUBLE AS u FROM orders),
    tokens AS (SELECT o_orderkey, o_orderstatus, least(count(*) FILTER (upto <= u * total), any_value(k) - 1) AS token
        FROM drawn JOIN running ON o_orderstatus = l_linestatus GROUP BY o_orderkey, o_orderstatus)
    SELECT o_orderkey, o_orderstatus, l_returnflag FROM tokens JOIN flags USING (token)"""


@query(_MULTINOMIAL_SQL)
def multinomial_decode(spark, folder):
    """A return flag drawn for each order from the shares of its status."""
    plan, given = flag_probabilities(spark, folder)
    rows = _orders_with(spark, folder, given)
    return encode.decode_probabilities(
        rows, plan, keep=["o_orderkey", "o_orderstatus"], seed=7, row_key=["o_orderkey"]
    )


@query(
    f"""WITH {_FLAG_SQL} SELECT l_linestatus, arg_min(token, (-p, token)) AS token FROM probs
    GROUP BY l_linestatus"""
)
def most_likely_token(spark, folder):
    _, given = flag_probabilities(spark, folder)
    return given.select("l_linestatus", arrays.most_likely(F.col("p_l_returnflag")).alias("token"))


@query(
    """WITH p AS (SELECT count(*) AS n FROM part), checks("check", "column", rows) AS (
        SELECT 'missing column', 'p_brand', n FROM p
        UNION ALL SELECT 'different columns', 'p_brand', n FROM p UNION ALL SELECT 'different columns', 'p_maker', n FROM p
        UNION ALL SELECT 'not a number', 'p_name', count(*) FROM part WHERE try_cast(p_name AS DOUBLE) IS NULL
        UNION ALL SELECT 'not a number', 'p_size', 0
        UNION ALL SELECT 'identifier', 'p_partkey', n FROM p UNION ALL SELECT 'identifier', 'p_type', 0
        UNION ALL SELECT 'no range', 'p_size', n FROM p UNION ALL SELECT 'no range', 'p_retailprice', 0
        UNION ALL SELECT 'unseen value', 'p_partkey', 0
        UNION ALL SELECT 'unseen value', 'p_type', count(*) FROM part WHERE p_type = 'PROMO'
        UNION ALL SELECT 'outside the range', 'p_size', 0
        UNION ALL SELECT 'outside the range', 'p_retailprice', count(*) FROM part WHERE p_retailprice > 905)
    SELECT "check", "column", rows FROM checks"""
)
def checked_encoding(spark, folder):
    """What is wrong with a table of parts, counted while it is encoded by a plan of another one."""
    parts = table(spark, folder, "part")
    other = F.when(F.col("p_type") == "PROMO", "ECONOMY").otherwise(F.col("p_type"))
    known = parts.withColumns({"p_type": other, "p_retailprice": F.least("p_retailprice", F.lit(905.0))})
    kinds = {"p_partkey": "categorical", "p_size": "continuous", "p_retailprice": "continuous"}
    plan = encode.fit(known, include=["p_partkey", "p_type", "p_brand", "p_size", "p_retailprice"], overrides=kinds)
    given = parts.withColumnRenamed("p_brand", "p_maker").withColumn("p_size", F.lit(7))
    encoded, report = checks.encode_checked(
        given, plan, keep=["p_name"], numeric=["p_size", "p_name"], like=parts.columns
    )
    encoded.write.parquet(scratch(spark, "checked"))
    return spark.createDataFrame(report.rows(), checks.SCHEMA)


@query(
    f"""SELECT l_orderkey, l_linenumber, f.l_returnflag FROM lineitem l
    LEFT JOIN {_rank_sql("l_returnflag", "lineitem")} f ON f.token = l.l_linenumber - 2"""
)
def decode_unseen(spark, folder):
    """Line numbers taken as tokens of the return flag, of which most are unknown."""
    lines = table(spark, folder, "lineitem")
    plan = encode.fit(lines, include=["l_returnflag"])
    tokens = lines.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - 2).alias("l_returnflag"))
    return checks.decode_checked(tokens, plan, keep=["l_orderkey", "l_linenumber"])[0]


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def preview_rows(spark, folder):
    """The first rows of a table in an order."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return tables.preview(orders.orderBy(F.desc("o_totalprice"), "o_orderkey"), 20)


@query(_MULTINOMIAL_SQL)
def multinomial_by_group(spark, folder):
    """The same draws from one table of shares by status, joined by group and cell."""
    lines = table(spark, folder, "lineitem").select("l_linestatus", "l_returnflag")
    plan = encode.fit(lines, include=["l_returnflag"])
    tokens = encode.encode(lines, plan, keep=["l_linestatus"])
    counts = tokens.groupBy("l_linestatus", F.col("l_returnflag").alias("token")).agg(F.count("*").alias("share"))
    counts = cut_lineage(counts)
    # A status that no line has draws from all lines, which have no status here.
    every = counts.groupBy("token").agg(F.sum("share").alias("share")).withColumn("l_linestatus", F.lit(None).cast("string"))
    known = counts.select("l_linestatus").distinct().withColumn("known", F.lit(True))
    orders = lookups.look_up(
        table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderstatus").alias("l_linestatus")),
        known,
        "l_linestatus",
    )
    orders = orders.withColumn("l_linestatus", F.when(F.col("known"), F.col("l_linestatus"))).drop("known")
    drawn = guide.draw(orders, counts.unionByName(every), ["l_linestatus"], 7, ["o_orderkey"], "l_returnflag")
    return encode.decode(drawn, plan, keep=["o_orderkey", "o_orderstatus"])
