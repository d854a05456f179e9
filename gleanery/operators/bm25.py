"""BM25 retrieval: many queries against one index in one job."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions.text import tokenize
from gleanery.operators.index import Index, field_tokens
from gleanery.operators.phrase_scan import phrase_holders
from gleanery.operators.scoring import summed
from gleanery.session import materialize

# Ranking constants and field boosts.
K1 = 1.2
B = 0.75
BOOSTS = {"title": 2.5, "description": 1.5, "content": 1.0}

# float sums come in any order: equal documents must tie. Query outputs round further.
SCORE_DIGITS = 9
#: Queries, and documents, of one phrase that meet in a cell; rows of the result for which another task is taken.
CELL_SIDE, PAIRS_PER_TASK = 1 << 12, 1 << 22


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, q) → (query_id, term, qtf): a repeated word is a repeated clause."""
    return (
        queries.select("query_id", F.explode(tokenize(F.col("q"))).alias("term"))
        .groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    )


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + 0.5) / (df + 0.5))


def _join_keys(left: DataFrame, right: DataFrame) -> list[str]:
    keys = ["field", "term"]
    if "term_bucket" in left.columns and "term_bucket" in right.columns:
        keys.insert(0, "term_bucket")
    return keys


def read_terms(table: DataFrame, terms: DataFrame, index: Index, name: str) -> DataFrame:
    """The rows of a table of terms that hold one of ``terms``, read from their buckets only.

    The terms are written out first: a search has few, and a stored table gives the planner its true size.
    """
    wanted, keys = index.by_term(terms)
    # the comparison keeps all rows and marks this side as a filter for partition pruning
    return table.join(materialize(wanted, name).where(F.length("term") > 0), keys)


def term_statistics(index: Index, terms: DataFrame, name: str = "terms") -> DataFrame:
    """The rows of ``term_stats`` of some terms; differences are added up for these terms only."""
    if index.term_deltas is None:
        return read_terms(index.term_stats, terms, index, name)
    found = read_terms(index.term_deltas, terms, index, name)
    return found.groupBy(*[c for c in found.columns if c != "df"]).agg(F.sum("df").alias("df")).where("df > 0")


def term_weights(index: Index, terms: DataFrame, boosts: Mapping[str, float] = BOOSTS) -> DataFrame:
    """Weight of every (query, field, term) that occurs in the corpus.

    The result is written out: it is small beside the postings, and a stored table gives the
    planner its true size, so that it broadcasts it up to its threshold and shuffles beyond.
    """
    boost = F.create_map(*[F.lit(v) for pair in boosts.items() for v in pair])
    # field_stats has one row per field, three at most
    stats = index.field_stats.where(F.col("field").isin(*boosts))
    weighted = (
        term_statistics(index, terms).join(F.broadcast(stats), "field")
        .withColumn("weight", boost[F.col("field")] * F.col("qtf") * idf(F.col("n_docs"), F.col("df")))
    )
    keep = [c for c in ("term_bucket",) if c in weighted.columns]
    extra = [c for c in terms.columns if c not in ("query_id", "term", "qtf")]
    out = weighted.select("query_id", "field", "term", *keep, "weight", "avg_len", *extra)
    # the comparison keeps all rows and marks this side as a filter for partition pruning
    return materialize(out, "weights").where(F.col("weight") > 0)


def _part(weight: Column) -> Column:
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("doc_len") / F.col("avg_len"))
    return weight * F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + norm)


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct ``keys`` of ``rows`` with a number each, written once."""
    return materialize(rows.select(*keys).distinct().withColumn("term_id", F.monotonically_increasing_id()), "numbered")


def _scored(index: Index, terms: DataFrame, boosts: Mapping[str, float], best: int | None = None) -> DataFrame:
    terms = materialize(terms, "query-terms")
    index = index.of_terms(terms)
    weights = term_weights(index, terms, boosts)
    keys = _join_keys(index.postings, weights)
    numbered = _numbered(weights, [*keys, "avg_len"])
    # the comparison keeps all rows and marks this side as a filter for partition pruning
    matched = index.postings.join(numbered.where(F.length("term") > 0), keys).select(
        "doc_id", "term_id", _part(F.lit(1.0)).alias("part"))
    return summed(matched, weights.join(numbered, keys).select("query_id", "term_id", "weight"), SCORE_DIGITS, best)


def _asked_once(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms of one query of each group of queries with the same terms, and (query_id, asked): the query asked for each."""
    terms = materialize(terms, "query-terms")
    word = F.struct("term", "qtf")
    named = terms.groupBy("query_id").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64(word)).alias("n1"), F.bit_xor(F.xxhash64(F.lit(7), word)).alias("n2"))
    heads = named.groupBy("n", "n1", "n2").agg(F.min("query_id").alias("asked"))
    members = materialize(named.join(heads, ["n", "n1", "n2"]).select("query_id", "asked"), "members")
    return terms.join(members.select(F.col("asked").alias("query_id")).distinct(), "query_id", "left_semi"), members


def _for_members(found: DataFrame, members: DataFrame) -> DataFrame:
    return members.join(found.withColumnRenamed("query_id", "asked"), "asked").drop("asked")


def bm25_scores(index: Index, queries: DataFrame, boosts: Mapping[str, float] = BOOSTS) -> DataFrame:
    """(query_id, doc_id, score) of every document matching any term in any field."""
    return _scored(index, query_terms(queries), boosts)


def top_k(scored: DataFrame, k: int, offset: int = 0, key: str = "query_id", score: str = "score",
          tie: str = "doc_id") -> DataFrame:
    """Rows ``offset`` … ``offset + k`` of each key with a 0-based ``rank``; empty past the end.

    The row-number filter becomes a per-partition limit before the shuffle.
    """
    by_score = W.partitionBy(key).orderBy(F.desc(score), F.asc(tie))
    ranked = scored.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= offset + k)
    return ranked.where(F.col("rank") > offset).withColumn("rank", (F.col("rank") - 1).cast("long"))


def bm25_search(index: Index, queries: DataFrame, k: int = 10, offset: int = 0,
                boosts: Mapping[str, float] = BOOSTS) -> DataFrame:
    """Top documents per query → (query_id, rank, doc_id, score). Equal queries are asked once."""
    terms, members = _asked_once(query_terms(queries))
    best = top_k(_scored(index, terms, boosts, best=k + offset), k, offset).select("query_id", "rank", "doc_id", "score")
    return _for_members(best, members).select("query_id", "rank", "doc_id", "score")


def match_counts(index: Index, queries: DataFrame) -> DataFrame:
    """Documents matching each query, zero included."""
    terms, members = _asked_once(query_terms(queries))
    index = index.of_terms(terms)
    wanted, keys = index.by_term(terms.select("term").distinct())
    numbered = _numbered(wanted, keys)
    # the comparison keeps all rows and marks this side as a filter for partition pruning
    matched = index.postings.join(numbered.where(F.length("term") > 0), keys).select("doc_id", "term_id", F.lit(1.0).alias("part"))
    asked = terms.join(numbered, "term").select("query_id", "term_id", F.lit(1.0).alias("weight"))
    found = summed(matched, asked, 0, counts=True).groupBy("query_id").agg(F.sum("total").alias("total_hits"))
    counts = _for_members(found, members)
    return queries.select("query_id").join(counts, "query_id", "left").na.fill(0, ["total_hits"])


def phrase_digest(words: Column) -> tuple[Column, Column]:
    """A 128-bit name of a sequence of words: columns ``p1`` and ``p2``."""
    return F.xxhash64(words).alias("p1"), F.xxhash64(F.lit(7), words).alias("p2")


def phrase_places(index: Index, phrases: DataFrame) -> DataFrame:
    """Phrases (words, an array) → (p1, p2, field, doc_id, start): every place where the words stand next to each other.

    Equal phrases are looked up once. Only the rarest word of a phrase proposes starts; each is settled by the digest of
    the words that stand there in the text, so the long lists of frequent words are not read.
    """
    named = materialize(phrases.select(*phrase_digest(F.col("words")), "words").dropDuplicates(["p1", "p2"]), "phrases")
    parts = named.select("p1", "p2", F.size("words").alias("n"), F.posexplode("words").alias("i", "term"))
    total = term_statistics(index, parts.select("term").distinct(), "words").groupBy("term").agg(F.sum("df").alias("df"))
    rarest = parts.join(total, "term").groupBy("p1", "p2", "n").agg(F.min(F.struct("df", "i", "term")).alias("r"))
    rare = rarest.select("p1", "p2", "n", "r.i", "r.term")
    proposed = read_terms(index.positions, rare, index, "rare").select(
        "p1", "p2", "n", "field", "doc_id", (F.col("pos") - F.col("i")).alias("start")).where("start >= 0")
    proposed = materialize(proposed, "starts")
    if index.tokens is not None:
        texts = index.tokens
    else:
        asked, keys = index.by_doc(proposed.select("doc_id").distinct())
        asked = materialize(asked, "asked")
        if "doc_bucket" in keys:
            # the comparison keeps all rows and marks this side as a filter for partition pruning
            asked = asked.where(F.col("doc_bucket") >= 0)
        texts = field_tokens(asked.join(index.docs, keys))
    texts = texts.where(F.col("tokens").isNotNull())
    p1, p2 = phrase_digest(F.slice("tokens", F.col("start") + 1, F.col("n")))
    return proposed.join(texts, ["field", "doc_id"]).where((F.col("p1") == p1) & (F.col("p2") == p2)).select(
        "p1", "p2", "field", "doc_id", "start")


def phrase_matches(index: Index, phrases: DataFrame) -> DataFrame:
    """(query_id, phrase) → (query_id, doc_id) where some field holds the words next to each other.

    Equal phrases are looked up once, in one pass over the texts where the index is built from them. The result may be the square of
    a group of equal phrases, so it is made in cells of bounded sides and not moved; only queries of several phrases are made distinct.
    """
    words = phrases.select("query_id", tokenize(F.col("phrase")).alias("words")).where(F.size("words") > 0)
    digests = words.select("query_id", *phrase_digest(F.col("words")), "words")
    named = materialize(digests.select("p1", "p2", "words").dropDuplicates(["p1", "p2"]).withColumn(
        "phrase_id", F.monotonically_increasing_id()), "phrases")
    asked = materialize(digests.select("query_id", "p1", "p2").distinct().join(named.drop("words"), ["p1", "p2"]).select(
        "query_id", "phrase_id"), "asked")
    if index.fields is not None:
        found = phrase_holders(index.docs, named.select("phrase_id", "words"))
    else:
        found = phrase_places(index, named.select("words")).select("p1", "p2", "doc_id").distinct().join(
            named.drop("words"), ["p1", "p2"]).select("phrase_id", "doc_id")
    found = materialize(found, "found")
    several = materialize(asked.groupBy("query_id").agg(F.count("*").alias("n")).where("n > 1").select("query_id"), "several")
    if several.isEmpty():
        return _pairs(asked, found)
    return _pairs(asked.join(several, "query_id", "left_anti"), found).unionByName(
        _pairs(asked.join(several, "query_id", "left_semi"), found).distinct())


def _pairs(asked: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, doc_id) of every query and document of a phrase, in cells of ``CELL_SIDE`` queries by as many documents, about."""
    sides = asked.groupBy("phrase_id").agg(F.count("*").alias("q")).join(
        found.groupBy("phrase_id").agg(F.count("*").alias("d")), "phrase_id")
    sides = materialize(sides.select(
        "phrase_id", F.ceil(F.col("q") / CELL_SIDE).cast("int").alias("q_tiles"), F.ceil(F.col("d") / CELL_SIDE).cast("int").alias("d_tiles"),
        (F.col("q").cast("double") * F.col("d")).alias("n")), "sides")
    total = sides.agg(F.sum("n")).first()[0] or 0
    large = sides.where("q_tiles > 1 OR d_tiles > 1").drop("n")
    tasks = max(asked.sparkSession.sparkContext.defaultParallelism, int(total // PAIRS_PER_TASK) + 1)

    def tile(key: str, tiles: str) -> Column:
        return F.pmod(F.xxhash64(key), F.coalesce(tiles, F.lit(1))).cast("int")

    def every(tiles: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.coalesce(tiles, F.lit(1)) - 1))

    keys = ["phrase_id", "q_tile", "d_tile"]
    # a fixed number of tasks: by their few bytes the cells would be thrown together into one
    left = asked.join(large, "phrase_id", "left").select(
        "query_id", "phrase_id", tile("query_id", "q_tiles").alias("q_tile"), every("d_tiles").alias("d_tile")).repartition(tasks, *keys)
    right = found.join(large, "phrase_id", "left").select(
        "doc_id", "phrase_id", tile("doc_id", "d_tiles").alias("d_tile"), every("q_tiles").alias("q_tile")).repartition(tasks, *keys)
    return left.join(right, keys).select("query_id", "doc_id")


def bm25_search_filtered(index: Index, queries: DataFrame, k: int = 10, offset: int = 0,
                         boosts: Mapping[str, float] = BOOSTS) -> DataFrame:
    """BM25 with required words, excluded words and a phrase.

    ``queries`` is (query_id, q, must ARRAY, must_not ARRAY, phrase); each of the last three may
    be null; a phrase without words counts as none. Required words score as well; a document is dropped when it lacks one of them, holds
    an excluded word, or lacks the phrase.
    """
    def words(column: str) -> Column:
        return F.coalesce(F.flatten(F.transform(F.col(column), lambda w: tokenize(w))), F.array().cast("array<string>"))

    clauses = queries.select("query_id", F.explode(F.concat(
        F.transform(tokenize(F.col("q")), lambda t: F.struct(t.alias("term"), F.lit("should").alias("role"))),
        F.transform(words("must"), lambda t: F.struct(t.alias("term"), F.lit("must").alias("role"))),
        F.transform(words("must_not"), lambda t: F.struct(t.alias("term"), F.lit("not").alias("role"))),
    )).alias("c")).select("query_id", "c.term", "c.role")
    terms = materialize(clauses.groupBy("query_id", "term", "role").agg(F.count("*").alias("qtf")), "clauses")
    needed = queries.select("query_id", F.size(F.array_distinct(words("must"))).alias("n_must"),
                            (F.size(tokenize(F.coalesce("phrase", F.lit("")))) > 0).alias("has_phrase"))
    phrases = queries.where(F.col("phrase").isNotNull()).select("query_id", "phrase")
    index = index.of_terms(terms.select("term").union(phrases.select(F.explode(tokenize(F.col("phrase"))))))
    scored = _scored(index, terms.where("role <> 'not'").groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf")), boosts)

    def holding(role: str) -> DataFrame:
        found = read_terms(index.postings.where(F.col("field").isin(*boosts)), terms.where(F.col("role") == role).select("query_id", "term"), index, role)
        return found.select("query_id", "doc_id", "term").distinct()

    must = holding("must").groupBy("query_id", "doc_id").agg(F.count("*").alias("got_must"))
    in_phrase = phrase_matches(index, phrases).withColumn("in_phrase", F.lit(True))
    pair = ["query_id", "doc_id"]
    kept = (
        scored.join(needed, "query_id").join(in_phrase, pair, "left").where(~F.col("has_phrase") | F.col("in_phrase"))
        .join(must, pair, "left").where(F.coalesce("got_must", F.lit(0)) == F.col("n_must"))
        .join(holding("not"), pair, "left_anti"))
    return top_k(kept, k, offset).select("query_id", "rank", "doc_id", "score")
