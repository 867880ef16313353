"""Fitting an invertible table encoding and applying it both ways.

The fitted plan is small facts per column plus a vocabulary table ``column,
token, value, n, weight``. Vocabularies of any size stay a table in the shared
folder; only those of few values become literals in the query.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.functions import arrays, draws, scale
from tallyweave.functions.columns import col, text
from tallyweave.operators import profile as profiling
from tallyweave.operators.lookups import (
    BROADCAST_BYTES,
    BROADCAST_ROWS,
    HOT_KEYS,
    split_join,
)
from tallyweave.operators.tables import (
    encodable_columns,
    require_columns,
    require_numeric,
    with_row_ids,
)
from tallyweave.session import cut_lineage, scratch

# A column of fewer distinct values is categorical; minutes of a day.
MAX_CATEGORIES = 25
DAY = (0.0, 1440.0)
#: Values of one column that a vocabulary takes, and weights that the driver reads.
MAX_VALUES, MAX_WEIGHTS = 100_000_000, 20_000_000

# Vocabularies up to this size are written into the query as literals.
LITERALS = 64
LITERAL_BYTES = 64 << 10

# One side of a join in a shuffle's partition is hashed up to this size, and both are sorted beyond it; what a
# word takes there besides its text.
HASHED_BYTES, WORD_BYTES = 128 << 20, 72

KINDS = ("categorical", "continuous", "time")


@dataclass(frozen=True)
class ColumnPlan:
    """How one column is encoded. ``low`` and ``span`` are for numbers only.

    ``bytes`` is what the values of a vocabulary take as text.
    """

    name: str
    kind: str
    dtype: str
    size: int = 1
    low: float | None = None
    span: float | None = None
    mean: float | None = None
    std: float | None = None
    has_null: bool = False
    bytes: int = 0

    def is_literal(self) -> bool:
        few = self.size <= LITERALS and self.bytes <= LITERAL_BYTES
        return self.kind == "categorical" and few

    def is_small(self, rows: int | None = None) -> bool:
        return self.size <= (BROADCAST_ROWS if rows is None else rows) and self.bytes <= BROADCAST_BYTES


@dataclass(frozen=True)
class EncodingPlan:
    columns: tuple[ColumnPlan, ...]
    vocabulary: DataFrame

    def __len__(self) -> int:
        return len(self.columns)

    def __getitem__(self, name: str) -> ColumnPlan:
        for plan in self.columns:
            if plan.name == name:
                return plan
        raise ValueError(f"column {name!r} is not part of the encoding")

    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def kinds(self) -> list[str]:
        return [c.kind for c in self.columns]

    def sizes(self) -> dict[str, int]:
        return {c.name: c.size for c in self.columns}

    def only(self, names: Sequence[str]) -> EncodingPlan:
        """The plan of some of the columns."""
        return EncodingPlan(tuple(self[n] for n in names), self.vocabulary)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The facts per column as a table."""
        return spark.createDataFrame(
            [(c.name, c.kind, c.dtype, c.size, c.low, c.span, c.mean, c.std) for c in self.columns],
            "column string, kind string, dtype string, size int, minimum double, span double,"
            " mean double, std double",
        )

    def words(self, name: str) -> DataFrame:
        return self.vocabulary.where(F.col("column") == name)

    def weights(self) -> dict[str, list[float] | None]:
        """Weight of each token by column, none for numbers.

        They are read to the driver, so columns of more than ``MAX_WEIGHTS`` values in all are refused.
        """
        total = sum(c.size for c in self.columns if c.kind == "categorical")
        if total > MAX_WEIGHTS:
            largest = max(self.columns, key=lambda c: c.size)
            raise ValueError(
                f"{total} weights are more than {MAX_WEIGHTS}: column {largest.name!r} has {largest.size}"
                " values; train without weights, or group its rare values"
            )
        found: dict[str, list[float] | None] = {
            c.name: [] if c.kind == "categorical" else None for c in self.columns
        }
        names = [name for name, weights in found.items() if weights is not None]
        rows = self.vocabulary.where(F.col("column").isin(names)).orderBy("column", "token")
        for row in rows.collect() if names else []:
            found[row["column"]].append(row["weight"])
        return found


def kind_rules(
    profiled: Mapping[str, Mapping],
    overrides: Mapping[str, str],
    max_categories: int,
) -> dict[str, str]:
    """Kind of each column from its type, its distinct values and the overrides."""
    kinds = {}
    for name, facts in profiled.items():
        dtype = facts["dtype"]
        if name in overrides:
            kinds[name] = overrides[name]
        elif profiling.is_text(dtype):
            kinds[name] = "categorical"
        elif facts["has_sentinel"] or facts["n_distinct"] < max_categories:
            kinds[name] = "categorical"
        elif profiling.is_number(dtype):
            kinds[name] = "continuous"
        else:
            raise ValueError(f"{dtype} column {name!r} is not supported; cast it, or say its kind in overrides")
        if kinds[name] not in KINDS:
            raise ValueError(f"unknown kind {kinds[name]!r} for column {name!r}")
    return kinds


def infer_kinds(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    overrides: Mapping[str, str] | None = None,
    max_categories: int = MAX_CATEGORIES,
    sentinel: float = profiling.SENTINEL,
) -> DataFrame:
    """``column, kind`` per column."""
    facts, _ = _facts(df, list(columns or df.columns), overrides or {}, max_categories, sentinel)
    kinds = kind_rules(facts, overrides or {}, max_categories)
    return df.sparkSession.createDataFrame(list(kinds.items()), "column string, kind string")


def _facts(df, names, overrides, max_categories, sentinel):
    """The profile by column, with exact distinct counts where a rule may depend on them.

    Also returns the distinct values of the columns that may turn out categorical.
    """
    require_columns(df, names)
    nested = [n for n in names if dict(df.dtypes)[n].startswith(("array", "map", "struct"))]
    if nested:
        raise ValueError(f"nested columns are not supported: {nested}")
    numbers = [n for n, kind in overrides.items() if n in names and kind != "categorical"]
    require_numeric(df, numbers)
    # Categories need no statistics of numbers.
    known = [n for n, kind in overrides.items() if n in names and kind == "categorical"]
    rows = profiling.profile(df, names, sentinel, counted=known).collect()
    facts = {row["column"]: row.asDict() for row in rows}

    def may_be_categorical(name):
        if name in overrides:
            return overrides[name] == "categorical"
        fact = facts[name]
        # The approximate count is within a few percent, so twice the limit is safely above it.
        few = fact["n_distinct"] <= 2 * max_categories
        return profiling.is_text(fact["dtype"]) or fact["has_sentinel"] or few

    candidates = [n for n in names if may_be_categorical(n)]
    if not candidates:
        return facts, None
    # Texts in free form would go through the shuffle as keys.
    large = [n for n in candidates if facts[n]["n_distinct"] > MAX_VALUES]
    if large:
        raise ValueError(
            f"columns {large} have more than {MAX_VALUES} values; exclude them, or recode them before"
        )
    many = [n for n in candidates if facts[n]["n_distinct"] > BROADCAST_ROWS]
    values = cut_lineage(profiling.column_values(df, candidates, many))
    length = F.sum(F.coalesce(F.octet_length("value"), F.lit(0)).cast("bigint"))
    sizes = values.groupBy("column").agg(F.count(F.lit(1)).alias("n"), length.alias("bytes"))
    for row in sizes.collect():
        facts[row["column"]].update(n_distinct=row["n"], bytes=row["bytes"])
    return facts, values


def number_tokens(values: DataFrame, largest: int) -> DataFrame:
    """Vocabulary from distinct values: tokens from 0 in native order, nulls first, and weights.

    The weight of a value is the mean count over its own count, so the
    count-weighted mean weight is 1. ``largest`` is the size of the largest
    vocabulary; beyond what one task sorts with ease, numbering is distributed.
    """
    order = [
        F.col("whole").asc_nulls_first(),
        F.col("real").asc_nulls_first(),
        F.col("value").asc_nulls_first(),
    ]
    if largest <= BROADCAST_ROWS:
        numbered = values.withColumn(
            "token", F.row_number().over(Window.partitionBy("column").orderBy(*order)) - 1
        )
    else:
        placed = with_row_ids(values, [F.col("column"), *order], "place")
        starts = placed.groupBy("column").agg(F.min("place").alias("start"))
        numbered = placed.join(F.broadcast(starts), "column").withColumn(
            "token", (F.col("place") - F.col("start")).cast("int")
        )
    means = F.broadcast(values.groupBy("column").agg(F.avg("n").alias("mean_n")))
    return numbered.join(means, "column").select(
        "column",
        F.col("token").cast("int").alias("token"),
        "value",
        "n",
        (F.col("mean_n") / F.col("n")).alias("weight"),
    )


def fit(
    df: DataFrame,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] | None = None,
    overrides: Mapping[str, str | tuple[str, float, float]] | None = None,
    max_categories: int = MAX_CATEGORIES,
    sentinel: float = profiling.SENTINEL,
    forbid_identifiers: bool = False,
) -> EncodingPlan:
    """Decide how each column is encoded and number its categories.

    Two passes over ``df``: the profile of all columns and the distinct values
    of the ones that may be categorical; those of more than ``BROADCAST_ROWS`` values are read by themselves. The latter, as many rows as there are
    categories, go to the shared folder. ``overrides`` gives the kind of a column;
    ``("time", start, cycle)`` is a time with its own start and length of cycle.
    """
    cycles = {n: kind[1:] for n, kind in (overrides or {}).items() if not isinstance(kind, str)}
    overrides = {n: "time" if n in cycles else kind for n, kind in (overrides or {}).items()}
    names = encodable_columns(df.columns, include, exclude)
    facts, values = _facts(df, names, overrides, max_categories, sentinel)
    kinds = kind_rules(facts, overrides, max_categories)
    plans = []
    for name in names:
        fact, kind = facts[name], kinds[name]
        if kind == "categorical":
            if forbid_identifiers and fact["n_distinct"] == fact["n_rows"]:
                raise ValueError(f"column {name!r} has a different value in every row")
            size, has_null = fact["n_distinct"], fact["n_null"] > 0
            plans.append(
                ColumnPlan(
                    name, kind, fact["dtype"], size, has_null=has_null, bytes=fact.get("bytes", 0)
                )
            )
            continue
        low, span = cycles.get(name, DAY) if kind == "time" else (fact["minimum"], fact["span"])
        if not span:
            raise ValueError(f"all values of {name!r} are the same, a range of one value; exclude it or make it categorical")
        plans.append(
            ColumnPlan(name, kind, fact["dtype"], 1, low, span, fact["mean"], fact["std"])
        )
    categories = [p for p in plans if p.kind == "categorical"]
    if values is None:
        vocabulary = df.sparkSession.createDataFrame(
            [], "column string, token int, value string, n bigint, weight double"
        )
    else:
        kept = values.where(F.col("column").isin([p.name for p in categories]))
        vocabulary = cut_lineage(number_tokens(kept, max([p.size for p in categories], default=0)))
    return EncodingPlan(tuple(plans), vocabulary)


def vocabulary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, token, value, n, weight`` of the given columns, whatever their types."""
    return fit(df, include=columns, overrides={c: "categorical" for c in columns}).vocabulary


def _literal_words(plan: EncodingPlan) -> dict[str, list]:
    """Values in token order of the columns with few of them, in one small job."""
    few = [c.name for c in plan.columns if c.is_literal()]
    words: dict[str, list] = {name: [] for name in few}
    if few:
        for row in (
            plan.vocabulary.where(F.col("column").isin(few)).orderBy("column", "token").collect()
        ):
            words[row["column"]].append(row["value"])
    return words


def _fail(message: str, shown: Column, dtype: str) -> Column:
    return F.raise_error(F.concat(F.lit(message), text(shown))).cast(dtype)


def _with_words(
    df: DataFrame, plan: EncodingPlan, name: str, by: str, adds: str, key: Column
) -> DataFrame:
    """Add ``adds`` of the vocabulary as ``__found``, matching ``key`` with its ``by`` column."""
    words = plan.words(name).where(F.col("value").isNotNull())
    value = F.col("value").cast(plan[name].dtype).alias("value")
    words = words.select(value, "token", "n")
    lookup = words.select(F.col(by).alias("__key_in"), F.col(adds).alias("__found"))
    keyed = df.withColumn("__key_in", key)
    if plan[name].is_small():
        return keyed.join(F.broadcast(lookup), "__key_in", "left").drop("__key_in")
    # The counts in the vocabulary already tell which values are frequent.
    hot = words.orderBy(F.desc("n"), by).limit(HOT_KEYS).select(F.col(by).alias("__key_in"))
    return split_join(keyed, lookup, "__key_in", hot).drop("__key_in")


def _many_words(plan: EncodingPlan, names: Sequence[str], by: str, adds: str) -> dict[str, tuple[DataFrame, DataFrame | None]]:
    """``__key, __found`` of every column's words, and those of its hot ones if there are any.

    A word is hot if it has more than one in ``HOT_KEYS`` of the column's rows, so there are fewer than that.
    """
    words = plan.vocabulary.where(F.col("column").isin(list(names)) & F.col("value").isNotNull())
    sums = {r["column"]: r["n"] for r in words.groupBy("column").agg(F.sum("n").alias("n")).collect()}
    above = F.lit(False)
    for name, n in sums.items():
        above |= (F.col("column") == name) & (F.col("n") * F.lit(HOT_KEYS) > F.lit(n))
    hot = cut_lineage(words.where(above))
    with_hot = {r["column"] for r in hot.select("column").distinct().collect()}

    def lookup(table: DataFrame, name: str) -> DataFrame:
        dtype = plan[name].dtype
        value = F.col("value").cast(dtype)
        # Numbers are joined as they are, other values as the text that the vocabulary has.
        key = F.col("token") if by == "token" else value if profiling.is_number(dtype) else F.col("value")
        found = F.col("token") if adds == "token" else value
        table = table.where(F.col("column") == name).select(key.alias("__key"), found.alias("__found"))
        if by == "value" and dtype.startswith("timestamp"):
            # Two instants may have one text where clocks are set back.
            table = table.groupBy("__key").agg(F.max("__found").alias("__found"))
        return table

    return {n: (lookup(words, n), lookup(hot, n) if n in with_hot else None) for n in names}


def _with_many_words(
    df: DataFrame,
    plan: EncodingPlan,
    large: Mapping[str, str],
    rest: Sequence[str],
    key: Callable[[ColumnPlan, Column], Column],
    by: str,
    adds: str,
    resolved: Callable[[ColumnPlan, Column, Column], Column],
    dealt: Callable[[ColumnPlan], bool],
) -> DataFrame:
    """``rest`` and ``__found_<name>`` for several large columns: ``resolved(plan, source, found)`` of the vocabulary's ``adds``.

    ``large`` has the column of ``df`` for every name. The rows are written once, with a number each. Number and sources
    alone go from join to join, one for each column, in which a source is
    replaced by what it stands for; hot words are found by broadcast. ``rest`` is joined back by the number at last. So
    other columns are shuffled once, however many large ones there are, and nothing is melted or grouped. Null keys, if ``dealt``, and
    rows of hot words are dealt out.
    """
    spark = df.sparkSession
    path = scratch(spark, "rows")
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    # Values of large vocabularies fill a dictionary in vain.
    rows.write.option("parquet.enable.dictionary", "false").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.select("__row", *[col(source).alias(f"__source_{n}") for n, source in large.items()])
    for name, (words, hot) in _many_words(plan, list(large), by, adds).items():
        c, source = plan[name], col(f"__source_{name}")
        on, value = ["__key"], F.col("__found")
        if hot is None and not dealt(c) and key(c, source) is source:
            on = [f"__source_{name}"]
            words = words.withColumnRenamed("__key", *on)
        else:
            found = found.withColumn("__key", key(c, source))
        if hot is not None:
            found = found.join(F.broadcast(hot.withColumnRenamed("__found", "__hot")), "__key", "left")
            found = found.withColumn("__key", F.when(F.col("__hot").isNull(), F.col("__key")))
            value = F.coalesce("__hot", "__found")
        if hot is not None or dealt(c):
            on = ["__key", "__spread"]
            place = F.when(F.col("__key").isNull(), F.pmod(F.xxhash64("__row"), F.lit(4096))).otherwise(F.lit(0))
            found = found.withColumn("__spread", place.cast("int"))
            # Always 0, but not a literal: the optimizer would take that out of the join keys.
            words = words.withColumn("__spread", F.pmod(F.xxhash64("__key"), F.lit(1)).cast("int"))
        if c.size * WORD_BYTES + c.bytes <= parts * HASHED_BYTES:
            words = words.hint("shuffle_hash")
        found = found.join(words, on, "left").withColumn(f"__found_{name}", resolved(c, source, value))
        found = found.drop("__key", "__found", "__hot", "__spread", f"__source_{name}")
    if rest:
        of_fixed_size = not any(t.startswith(("string", "char", "varchar", "binary")) for _, t in found.dtypes)
        if of_fixed_size and rows.count() * (WORD_BYTES + 8 * len(large)) <= parts * HASHED_BYTES:
            found = found.hint("shuffle_hash")
        found = rows.select("__row", *map(col, rest)).join(found, "__row")
    return found.drop("__row")


def encode(
    df: DataFrame,
    plan: EncodingPlan,
    keep: Sequence[str] = (),
    unseen: str = "error",
    prefix: str = "",
    as_vector: str | None = None,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """Numbers for every column of the plan: tokens, or values scaled to the unit interval.

    ``keep`` columns are passed through. A value not in the vocabulary is an
    error that names it, or the token -1 with ``unseen="code"``. ``as_vector``
    names an extra ``array<double>`` column of all the numbers of the row. Vocabularies of more than ``broadcast_rows``
    words (``BROADCAST_ROWS``) are joined by shuffling, together if there are several.
    """
    if unseen not in ("error", "code"):
        raise ValueError("unseen must be 'error' or 'code'")
    require_columns(df, plan.names())
    literal = _literal_words(plan)
    large = [c for c in plan.columns if c.kind == "categorical" and c.name not in literal and not c.is_small(broadcast_rows)]

    def token_of(c: ColumnPlan, source: Column, found: Column) -> Column:
        unknown = F.lit(-1) if unseen == "code" else _fail(f"{c.name}: value not in the vocabulary: ", source, "int")
        # Nulls sort first, so theirs is always token 0.
        nulls = F.when(source.isNull(), F.lit(0)) if c.has_null else F.lit(None).cast("int")
        return F.coalesce(found, nulls, unknown)

    if len(large) > 1:
        several = {c.name: c.name for c in large}
        rest = list(dict.fromkeys([*keep, *[n for n in plan.names() if n not in several]]))
        needed = dict.fromkeys([*rest, *several])
        df = _with_many_words(
            df.select(*map(col, needed)),
            plan,
            several,
            rest,
            lambda c, source: source if profiling.is_number(c.dtype) else source.cast("string"),
            "value",
            "token",
            token_of,
            lambda c: c.has_null or unseen == "code",
        )
    out = {}
    for c in plan.columns:
        source = col(c.name)
        if c.kind != "categorical":
            out[c.name] = scale.scale(source, c.low, c.span)
            continue
        if c.name in literal:
            pairs = []
            for token, value in enumerate(literal[c.name]):
                if value is not None:
                    pairs += [F.lit(value).cast(c.dtype), F.lit(token)]
            found = F.create_map(*pairs)[source] if pairs else F.lit(None).cast("int")
        elif len(large) > 1 and c in large:
            out[c.name] = col(f"__found_{c.name}")
            continue
        else:
            df = _with_words(df, plan, c.name, "value", "token", source)
            df = df.withColumnRenamed("__found", f"__token_{c.name}")
            found = col(f"__token_{c.name}")
        out[c.name] = token_of(c, source, found)
    columns = [*map(col, keep), *[value.alias(prefix + name) for name, value in out.items()]]
    encoded = df.select(*columns)
    if as_vector is None:
        return encoded
    return encoded.withColumn(
        as_vector, F.array(*[col(prefix + n).cast("double") for n in plan.names()])
    )


def encode_column(df: DataFrame, plan: EncodingPlan, name: str, **options) -> DataFrame:
    return encode(df, plan.only([name]), **options)


def unseen_values(df: DataFrame, plan: EncodingPlan) -> DataFrame:
    """``column, value, n`` of the values that the vocabulary does not hold."""
    names = [c.name for c in plan.columns if c.kind == "categorical"]
    found = profiling.column_values(df, names).select("column", "value", "n")
    same = F.col("f.column").eqNullSafe(F.col("v.column")) & F.col("f.value").eqNullSafe(
        F.col("v.value")
    )
    return found.alias("f").join(plan.vocabulary.alias("v"), same, "left_anti")


def decode(
    df: DataFrame,
    plan: EncodingPlan,
    keep: Sequence[str] = (),
    prefix: str = "",
    broadcast_rows: int | None = None,
) -> DataFrame:
    """Values from the numbers of :func:`encode`, in their source types.

    Large vocabularies are joined as there. A token outside the vocabulary is an error that names it.
    """
    names = [prefix + n for n in plan.names()]
    require_columns(df, names)
    literal = _literal_words(plan)
    large = [c for c in plan.columns if c.kind == "categorical" and c.name not in literal and not c.is_small(broadcast_rows)]

    def value_of(c: ColumnPlan, source: Column, found: Column) -> Column:
        known = (source >= 0) & (source < c.size)
        return F.when(known, found).otherwise(_fail(f"{c.name}: token not in the vocabulary: ", source, c.dtype))

    def key(c: ColumnPlan, source: Column) -> Column:
        # Null's token is in no join.
        source = source.cast("int")
        return F.when(source > 0, source) if c.has_null else source

    if len(large) > 1:
        several = {c.name: prefix + c.name for c in large}
        rest = list(dict.fromkeys([*keep, *[n for n in names if n not in several.values()]]))
        needed = dict.fromkeys([*rest, *several.values()])
        df = df.select(*map(col, needed))
        df = _with_many_words(df, plan, several, rest, key, "token", "value", value_of, lambda c: c.has_null)
    out = {}
    for c in plan.columns:
        source = col(prefix + c.name)
        if c.kind != "categorical":
            out[c.name] = scale.unscale(source, c.low, c.span, c.dtype)
            continue
        if c.name in literal:
            words = [F.lit(v).cast(c.dtype) for v in literal[c.name]]
            found = F.get(F.array(*words), source.cast("int"))
        elif len(large) > 1 and c in large:
            out[c.name] = col(f"__found_{c.name}")
            continue
        else:
            df = _with_words(df, plan, c.name, "token", "value", source)
            df = df.withColumnRenamed("__found", f"__value_{c.name}")
            found = col(f"__value_{c.name}")
        out[c.name] = value_of(c, source, found)
    return df.select(*map(col, keep), *[value.alias(name) for name, value in out.items()])


def decode_probabilities(
    df: DataFrame,
    plan: EncodingPlan,
    keep: Sequence[str] = (),
    prefix: str = "p_",
    seed: int | None = None,
    row_key: Sequence[str] = (),
) -> DataFrame:
    """Values from one probability array per categorical column (and one number otherwise).

    The most likely token of each, or with a ``seed`` a token drawn by it and the row key.
    """
    tokens = {}
    for c in plan.columns:
        source = col(prefix + c.name)
        if c.kind != "categorical":
            tokens["__" + c.name] = source
        elif seed is None:
            tokens["__" + c.name] = arrays.most_likely(source)
        else:
            u = draws.uniform(seed, F.lit(c.name), *map(col, row_key))
            tokens["__" + c.name] = arrays.sampled(source, u)
    return decode(df.withColumns(tokens), plan, keep, prefix="__")
