"""Matching texts to the entity catalog."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gabble import catalog
from gabble.catalog import Entity
from gabble.functions import text as T
from gabble.session import written

#: Search phrases up to which each is compared in code of its own.
_UNROLLED = 64
#: Search phrases up to which every text is compared with every phrase.
_COMPARED = 1000
#: Characters of the pieces by which texts and many phrases meet.
_PIECE = 5


def attach_entity(df: DataFrame, entities: DataFrame, columns: Iterable[str],
                  *, strict: bool = False) -> DataFrame:
    """Left join of catalog columns on ``persoon``.

    Unknown persons keep nulls, or stop the job when ``strict`` is set. The catalog has one row per
    person; Spark broadcasts it while its known size allows and splits a dominant person otherwise.
    """
    columns = list(columns)
    marked = entities.select("persoon", *columns, F.lit(True).alias("_known"))
    joined = df.join(marked, "persoon", "left")
    if strict:
        unknown = F.raise_error(F.concat(F.lit("person not in catalog: "), F.col("persoon")))
        joined = joined.withColumn(
            "persoon", F.when(F.col("_known"), F.col("persoon")).otherwise(unknown))
    return joined.drop("_known")


def described(df: DataFrame, entities: DataFrame, column: str = "description") -> DataFrame:
    """Catalog text for each row's person, the key itself where the catalog has none."""
    return attach_entity(df, entities, [column]).withColumn(
        column, F.coalesce(F.col(column), F.col("persoon")))


def with_variants(df: DataFrame, entities: DataFrame, columns: Iterable[str],
                  prepare: Callable[[Column], Column]) -> DataFrame:
    """Attach variant lists, prepared for matching once per person instead of once per row."""
    columns = list(columns)
    prepared = entities.withColumns({c: F.transform(c, prepare) for c in columns})
    return attach_entity(df, prepared, columns)


def flag_names(df: DataFrame, entities: DataFrame) -> DataFrame:
    """Add ``name_in_comment`` and ``name_in_thread`` from the loose variants, without folding."""
    variants = F.col("loose_variants")
    return with_variants(df, entities, ["loose_variants"], F.lower).withColumns({
        "name_in_comment": T.contains_any(F.lower("comment"), variants),
        "name_in_thread": T.contains_any(F.lower("thread_title"), variants),
    }).drop("loose_variants")


def match_title(df: DataFrame, entities: DataFrame, title: str = "thread_title") -> DataFrame:
    """Add ``about``: the title contains a title variant of the row's person (folded)."""
    return with_variants(df, entities, ["title_variants"], T.fold).withColumn(
        "about", T.contains_any(T.fold(F.col(title)), F.col("title_variants"))
    ).drop("title_variants")


def match_comment(df: DataFrame, entities: DataFrame, comment: str = "comment") -> DataFrame:
    """Add ``mentioned``: the comment contains a strict variant of the row's person (folded)."""
    return with_variants(df, entities, ["strict_variants"], T.fold).withColumn(
        "mentioned", T.contains_any(T.fold(F.col(comment)), F.col("strict_variants"))
    ).drop("strict_variants")


def tier(df: DataFrame, entities: DataFrame, title: str = "title") -> DataFrame:
    """Add ``tier``: 1 for threads whose title names the person, 2 for the others."""
    return match_title(df, entities, title).withColumn(
        "tier", F.when(F.col("about"), 1).otherwise(2)).drop("about")


def filter_tier(df: DataFrame, entities: DataFrame, comment: str = "comment") -> DataFrame:
    """Keep every comment of tier 1 and those comments of tier 2 that name the person."""
    return match_comment(df, entities, comment).filter(
        (F.col("tier") == 1) | F.col("mentioned")).drop("mentioned")


def filter_phrase(df: DataFrame, phrase: str, text: str = "comment") -> DataFrame:
    """Rows whose text contains the phrase, ignoring case and accents."""
    return df.filter(T.fold(F.col(text)).contains(T.fold(F.lit(phrase))))


def search(df: DataFrame, entities: Iterable[Entity], text: str, keys: Iterable[str]) -> DataFrame:
    """One row ``keys, persoon, query_index`` per text and search phrase it contains.

    The phrases are driver-side parameters, so they travel inside the expression: every text is
    read once where it lies and only hits leave the task. There is no join and no shuffle. Catalogs of
    thousands go by :func:`search_many`, with the same result.
    """
    wanted = [(e.persoon, i, q) for e in entities for i, q in enumerate(e.search_queries)]
    if len(wanted) > _COMPARED:
        return search_many(df, df.sparkSession.createDataFrame(wanted, "persoon string, query_index int, phrase string"), text, keys)
    texts = df.filter(F.col(text).isNotNull()).select(*keys, T.fold(F.col(text)).alias("_text"))

    def hit(person: str, number: int) -> Column:
        return F.struct(F.lit(person).alias("persoon"), F.lit(number).alias("query_index"))

    if len(wanted) <= _UNROLLED:
        # A comparison with a constant each: compiled code instead of a lambda per phrase and text.
        hits = F.array_compact(F.array(*[
            F.when(F.col("_text").contains(T.fold(F.lit(q))), hit(person, i)) for person, i, q in wanted]))
    else:
        phrases = F.array(*[F.struct(hit(person, i).alias("hit"), T.fold(F.lit(q)).alias("phrase"))
                            for person, i, q in wanted])
        hits = F.transform(F.filter(phrases, lambda p: F.col("_text").contains(p["phrase"])), lambda p: p["hit"])
    return (
        texts.select(*keys, F.explode(hits).alias("_hit"))
        .select(*keys, "_hit.persoon", "_hit.query_index")
    )


def search_many(df: DataFrame, phrases: DataFrame, text: str, keys: Iterable[str]) -> DataFrame:
    """:func:`search` for a table of phrases (``persoon, query_index, phrase``) of any size.

    A text that contains a phrase contains each of its pieces of ``_PIECE`` characters. So a phrase is looked up by the
    piece that the fewest texts have, in an equi-join, and only the texts that meet it there are compared with it:
    what a text costs depends on its length, not on the number of phrases. Phrases shorter than a piece are pieces
    of their own. Null phrases match nothing, empty ones stop the job.
    """
    keys = list(keys)
    texts = written(df.filter(F.col(text).isNotNull()).select(*keys, T.fold(F.col(text)).alias("_text"))
                    .withColumn("_row", F.monotonically_increasing_id()), "texts")
    folded = T.fold(F.col("phrase"))
    asked = phrases.filter(F.col("phrase").isNotNull()).select("persoon", "query_index", F.when(
        F.length(folded) > 0, folded).otherwise(F.raise_error(F.lit("empty search phrase"))).alias("_phrase"))
    asked = written(asked.withColumn("_size", F.least(F.length("_phrase"), F.lit(_PIECE))), "phrases")

    def pieces(of: str, size) -> Column:
        """All pieces of a text, overlapping."""
        return F.array_distinct(F.regexp_extract_all(of, F.concat(F.lit("(?s)(?=(.{"), size, F.lit("}))")), F.lit(1)))

    of_phrase = asked.select("_phrase", F.explode(pieces("_phrase", F.col("_size").cast("string"))).alias("_piece")).distinct()
    wanted = written(of_phrase, "pieces")
    sizes = sorted(r[0] for r in asked.select("_size").distinct().collect())  # at most _PIECE numbers
    if not sizes:
        return texts.join(asked, F.lit(False)).select(*keys, "persoon", "query_index")
    of_text = F.concat(*[pieces("_text", F.lit(str(n))) for n in sizes])
    met = written(texts.select("_row", F.explode(of_text).alias("_piece"))
                  .join(wanted.select("_piece").distinct(), "_piece", "left_semi"), "met")
    known = met.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    # A phrase with a piece that no text has is in no text.
    rarest = (wanted.join(known, "_piece", "left").groupBy("_phrase")
              .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_piece")).alias("least"))
              .filter("least.n > 0").select("_phrase", F.col("least._piece").alias("_piece")))
    pairs = met.join(written(rarest, "rarest"), "_piece").select("_row", "_phrase")
    found = (texts.join(pairs, "_row").filter(F.col("_text").contains(F.col("_phrase"))).select(*keys, "_phrase"))
    return found.join(asked.select("_phrase", "persoon", "query_index"), "_phrase").select(*keys, "persoon", "query_index")


def filter_allowlist(df: DataFrame, names: Iterable[str] = catalog.SUBREDDIT_ALLOWLIST) -> DataFrame:
    """Keep rows of the listed subreddits."""
    return df.filter(F.col("subreddit").isin(*names))


def filter_general(df: DataFrame, general: Iterable[str] = catalog.GENERAL_SUBREDDITS,
                   name: str = "persoon") -> DataFrame:
    """In general-interest subreddits keep only comments naming the person; keep all elsewhere."""
    return df.filter(~T.member(F.col("subreddit"), general)
                     | T.mentions(F.col("comment"), F.col(name)))
