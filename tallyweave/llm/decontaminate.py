"""Benchmark decontamination with a positional inverted index of the training texts.

Test items are looked up as phrases in the index, not the other way round:

1. Count the test items' terms in the training texts.
2. In every window of an item, its rarest term is an anchor. So every window holds an
   anchor, and few terms are anchors.
3. Store the postings (term, document, position) of the anchors.
4. Offset-adjusted lists: a posting at p of the item's term at i votes for the alignment (item,
   document, p - i). Lists of all anchors of a window are intersected, from the rarest; alignments
   on which a window has them all go on to the words of the document.
5. A window is found where all of its words stand at their offsets.

A proximity match has the rarest terms of a window in any order within a few more words. Lists of its anchors are intersected
by distance instead, and the words around what is left are looked at. Every exact match is one too.

Everything is built-in Spark expressions. Words are those of ``alnum_words``. The terms and anchors
of the test items are broadcast up to a size that is measured, and joined beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.registry import query, table
from tallyweave.llm.shared import alnum_words, if_small, keyed, stored, without

WINDOW = 10
#: Anchors of a window: its rarest terms, which must all be in place before words are compared.
ANCHORS = 2
#: Distinct terms of a window that a proximity match has, and consecutive words that they lie within.
TERMS, SPAN = 5, 2 * WINDOW


def item_words(items: DataFrame) -> DataFrame:
    """(item, item_id, words) of all items that have words, each once; ``item`` tells them apart."""
    words = items.select("item_id", alnum_words(F.col("text")).alias("words")).filter("size(words) > 0").distinct()
    return words.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words")


def document_words(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, words); rows equal in id and text are one ``doc``."""
    return keyed(docs).select("doc", "doc_id", alnum_words(F.col("text")).alias("words"))


def _item_terms(items: DataFrame) -> DataFrame:
    return items.select("item", F.size("words").alias("size"), F.posexplode("words").alias("at", "term"))


def term_counts(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences of those ``terms`` that the texts have."""
    tokens = words.select(F.explode("words").alias("term"))
    return tokens.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def anchors(items: DataFrame, counts: DataFrame, width: int = WINDOW, rarest: int = ANCHORS) -> DataFrame:
    """(item, first, at, term): the ``rarest`` terms of every window that may occur.

    ``first`` is the window's place in the item and ``at`` the term's. A window with a term that no training
    text has cannot occur and is left out.
    """
    placed = _item_terms(items).join(counts, "term", "left")
    last = F.greatest(F.col("size") - width, F.lit(0))
    starts = F.sequence(F.greatest(F.col("at") - (width - 1), F.lit(0)), F.least("at", last))
    windows = placed.select("item", "at", "term", "n", F.explode(starts).alias("first"))
    own = Window.partitionBy("item", "first")
    return (
        windows.withColumn("missing", F.max(F.col("n").isNull()).over(own))
        .filter("not missing")
        .withColumn("place", F.row_number().over(own.orderBy("n", "term", "at")))
        .filter(F.col("place") <= rarest)
        .select("item", "first", "at", "term")
    )


def near_windows(
    items: DataFrame, counts: DataFrame, width: int = WINDOW, terms: int = TERMS, rarest: int = ANCHORS
) -> DataFrame:
    """(item, anchors, need): for every window its ``terms`` rarest distinct terms that training texts have, each list once.

    Terms that no training text has are passed over. A window with fewer distinct words needs all of them, and one that has not
    enough terms left is left out. ``anchors`` are the ``rarest`` of them.
    """
    placed = _item_terms(items).join(counts, "term", "left")
    last = F.greatest(F.col("size") - width, F.lit(0))
    starts = F.sequence(F.greatest(F.col("at") - (width - 1), F.lit(0)), F.least("at", last))
    distinct = placed.select("item", "term", "n", F.explode(starts).alias("first")).distinct()
    own = Window.partitionBy("item", "first")
    needed = F.least(F.lit(terms), F.count("*").over(own)).alias("needed")
    place = F.row_number().over(own.orderBy(F.col("n").asc_nulls_last(), "term")).alias("place")
    ranked = distinct.select("item", "first", "term", "n", needed, place).filter("place <= needed and n is not null")
    listed = ranked.groupBy("item", "first", "needed").agg(F.sort_array(F.collect_list(F.struct("place", "term"))).alias("ranked"))
    need = F.transform("ranked", lambda r: r["term"]).alias("need")
    listed = listed.filter(F.size("ranked") == F.col("needed")).select("item", need).distinct()
    return listed.select("item", F.slice("need", 1, rarest).alias("anchors"), "need")


def alignments(index: DataFrame, picked: DataFrame) -> DataFrame:
    """(doc, doc_id, item, shift): where some window has all of its anchors in place.

    The word at i of the item is then to stand at ``shift + i`` of the document. Lists are intersected as
    rows grouped by alignment, so that no list is gathered and a frequent term is split.
    """
    lists = if_small(picked.select("item", "at", "term").distinct(), F.octet_length("term"))
    windows = picked.groupBy("item", "first").agg(F.collect_set("at").alias("ats"))
    windows = windows.groupBy("item").agg(F.collect_list("ats").alias("windows"))
    windows = if_small(windows, 8 * F.size(F.flatten("windows")))
    votes = index.join(lists, "term").select("doc", "doc_id", "item", (F.col("pos") - F.col("at")).alias("shift"), "at")
    placed = votes.groupBy("doc", "doc_id", "item", "shift").agg(F.collect_set("at").alias("placed"))
    whole = F.exists("windows", lambda ats: F.size(F.array_except(ats, F.col("placed"))) == 0)
    return placed.join(windows, "item").filter(whole).select("doc", "doc_id", "item", "shift")


class Search:
    """Test items looked up in the index of training texts.

    A window is ``width`` consecutive words of an item, or all of a shorter item. Null and empty texts have no
    words. Rows that are equal in id and text are one document, and a null id is an id like others;
    an item without an id counts in hits but has no id to name. Empty tables hit nothing,
    and other columns are ignored. Proximity matches are found where ``proximity`` asks for their lists in the index.
    """

    def __init__(
        self, docs: DataFrame, items: DataFrame, width: int = WINDOW, rarest: int = ANCHORS, proximity: bool = True
    ):
        self.docs, self.width = docs, width
        self.items = stored(item_words(items))
        self.words = document_words(docs)
        terms = if_small(_item_terms(self.items).select("term").distinct(), F.octet_length("term"))
        self.counts = stored(term_counts(self.words, terms))
        self.picked = stored(anchors(self.items, self.counts, width, rarest))
        wanted = self.picked.select("term")
        self.loose = stored(near_windows(self.items, self.counts, width, rarest=rarest)) if proximity else None
        if proximity:
            wanted = wanted.unionByName(self.loose.select(F.explode("anchors").alias("term")))
        self.index = self._index(wanted.distinct())

    def _index(self, terms: DataFrame) -> DataFrame:
        """The postings (doc, doc_id, n_words, pos, term) of ``terms``, stored.

        The first word of every document is there too, and a document without words has a row without a place.
        """
        size = F.size("words").cast("long").alias("n_words")
        tokens = self.words.select("doc", "doc_id", size, F.posexplode_outer("words").alias("pos", "term"))
        wanted = if_small(terms.withColumn("wanted", F.lit(True)), F.octet_length("term"))
        kept = tokens.join(wanted, "term", "left").filter("wanted or pos is null or pos = 0")
        return stored(kept.select("doc", "doc_id", "n_words", "pos", F.when(F.col("wanted"), F.col("term")).alias("term")))

    def phrases(self) -> DataFrame:
        """(doc, doc_id, item, item_id, start, stop): the stretches of words that windows of an item hit.

        Windows that overlap on one alignment are one stretch; ``stop`` is exclusive.
        """
        postings = self.index.filter("term is not null").select("doc", "doc_id", "pos", "term").distinct()
        aligned = stored(alignments(postings, self.picked))
        # Only documents with an alignment go on with their words.
        texts = self._hit_texts(aligned)
        placed = aligned.join(if_small(self.items.withColumnRenamed("words", "phrase"), F.octet_length(F.concat_ws(" ", "phrase"))), "item")
        return _stretches(placed.join(texts, "doc"), self.width).select("doc", "doc_id", "item", "item_id", "start", "stop")

    def near(self, span: int = SPAN) -> DataFrame:
        """(doc, doc_id, item, item_id, start): proximity matches, where the first one of each begins.

        An item is near where the ``TERMS`` rarest distinct terms of one of its windows (all, if it has fewer) stand in
        any order within ``span`` consecutive words; ``start`` is the first of these.
        """
        anchored = self.loose.select("item", F.explode("anchors").alias("term")).distinct()
        postings = self.index.filter("term is not null").select("doc", "doc_id", "pos", "term").distinct()
        hits = postings.join(if_small(anchored, F.octet_length("term")), "term")
        windows = self.loose.groupBy("item").agg(F.collect_list(F.struct("anchors", "need")).alias("windows"))
        windows = if_small(windows, F.octet_length(F.to_json("windows")))
        # Every posting opens a span, in which the anchors are looked for.
        ahead = Window.partitionBy("doc", "item").orderBy("pos").rangeBetween(0, span - 1)
        opened = hits.withColumn("held", F.collect_set("term").over(ahead)).join(windows, "item")
        anchors = F.exists("windows", lambda w: F.size(F.array_except(w["anchors"], F.col("held"))) == 0)
        opened = stored(opened.filter(anchors).select("doc", "doc_id", "item", "pos").distinct())
        placed = opened.join(windows, "item").join(self._hit_texts(opened), "doc")
        # All spans that hold the posting; the words of each have to hold a window's terms.
        begins = F.sequence(F.greatest(F.col("pos") - (span - 1), F.lit(0)), F.col("pos"))
        around = lambda s: F.slice("words", s + 1, F.lit(span))
        whole = lambda s: F.exists("windows", lambda w: F.size(F.array_except(w["need"], around(s))) == 0)
        found = placed.withColumn("start", F.array_min(F.filter(begins, whole))).filter("start is not null")
        found = found.groupBy("doc", "doc_id", "item").agg(F.min("start").alias("start"))
        return found.join(if_small(self.items.select("item", "item_id")), "item").select("doc", "doc_id", "item", "item_id", "start")

    def _hit_texts(self, hits: DataFrame) -> DataFrame:
        """(doc, words) of the documents of ``hits``, each once."""
        hit = if_small(hits.select("doc").distinct(), F.octet_length("doc.id"))
        texts = keyed(self.docs).select("doc", "text").join(hit, "doc", "left_semi")
        return texts.dropDuplicates(["doc"]).select("doc", alnum_words(F.col("text")).alias("words"))

    def report(self) -> DataFrame:
        """(doc, doc_id, n_words, n_hit, items, near) of every document.

        ``items`` are the ids hit, as strings, and ``near`` those of proximity matches, if these are asked for.
        """
        hits = stored(hit_words(stored(self.phrases())))
        every = self.index.select("doc", "doc_id", "n_words").distinct().join(hits, "doc", "left")
        none = F.array().cast("array<string>")
        names = [F.coalesce("items", none).alias("items")]
        if self.loose is not None:
            near = self.near().groupBy("doc").agg(F.collect_set(F.col("item_id").cast("string")).alias("near"))
            every = every.join(stored(near), "doc", "left")
            names.append(F.coalesce("near", none).alias("near"))
        n_hit = F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit")
        return every.select("doc", "doc_id", "n_words", n_hit, *names)


def _stretches(placed: DataFrame, width: int) -> DataFrame:
    """Runs of at least ``width`` (or all) item words that stand in the document, per alignment."""
    indexes = F.sequence(F.lit(0), F.size("phrase") - 1)
    # Item places whose word differs; between two of them lies a run.
    same = lambda i: F.get(F.col("phrase"), i) == F.get(F.col("words"), i + F.col("shift"))
    breaks = F.filter(indexes, lambda i: ~F.coalesce(same(i) & (i + F.col("shift") >= 0), F.lit(False)))
    edges = F.concat(F.array(F.lit(-1)), breaks, F.array(F.size("phrase")))
    runs = F.transform(
        F.slice(edges, 2, F.size(edges)), lambda stop, n: F.struct((F.get(edges, n) + 1).alias("start"), stop.alias("stop"))
    )
    least = F.least(F.lit(width), F.size("phrase"))
    runs = F.filter(runs, lambda r: r["stop"] - r["start"] >= least)
    return placed.withColumn("run", F.explode(runs)).select(
        "*", (F.col("run.start") + F.col("shift")).alias("start"), (F.col("run.stop") + F.col("shift")).alias("stop")
    )


def hit_words(stretches: DataFrame) -> DataFrame:
    """(doc, n_hit, items): words inside any stretch, each once, and the ids of the items hit.

    Stretches of a document are merged in order of their starts.
    """
    own = Window.partitionBy("doc").orderBy("start", "stop")
    reached = F.coalesce(F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), reached))
    counted = stretches.select("doc", "start", "stop").distinct().withColumn("fresh", fresh)
    names = stretches.groupBy("doc").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    return counted.groupBy("doc").agg(F.sum("fresh").alias("n_hit")).join(names, "doc")


def clean(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs."""
    return without(docs, Search(docs, items, width, proximity=False).phrases())


def ids_digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)


@query()
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in benchmark windows, the items hit, and those that are near."""
    found = Search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.report().select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        ids_digest(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
        ids_digest(F.col("near")).alias("near_sha256"),
    )
