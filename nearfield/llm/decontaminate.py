"""Benchmark decontamination on a positional inverted index, with DataFrame functions alone.

The index is a table of postings (term, document, position) of the benchmark's terms, written once: it gives the terms' counts, and phrase and proximity searches read it.
A benchmark window looks up its two rarest terms by their counts in the whole corpus; their posting lists, shifted back by the terms' places in the window, are intersected to
the starts at which the window can stand, and what is left is compared word by word with the document. Long posting lists of common words are read only by windows that have
nothing rarer. Tables of the benchmark's side are broadcast by Spark where their files are small, and shuffled otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import ALNUM_WORD, cut, drop, let, lower_ascii, noted, remove

WINDOW, RAREST = 10, 2
#: Words of a stretch in which the rarest terms of an item stand near each other, and how many terms.
SPAN, NEAR_TERMS = 30, 3


def words(text: Column) -> Column:
    """Words of letters and digits, A-Z in lower case."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(ALNUM_WORD), F.lit(0))


def document_key() -> Column:
    """What stands for a document in the index: equal for rows with the same doc_id and text, different for others, whose doc_id may be equal or null."""
    return F.xxhash64("doc_id", F.xxhash64("text"))


def places(docs: DataFrame) -> DataFrame:
    """(doc, pos, term) of every word of docs (doc_id, text), all letters in lower case, which costs less than A-Z alone; words that words() holds equal are equal here."""
    return docs.select(document_key().alias("doc"), F.posexplode(F.regexp_extract_all("text", F.lit(ALNUM_WORD), F.lit(0))).alias("pos", "word")).select("doc", "pos", F.lower("word").alias("term"))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(win, words) for each different window of items (item_id, text), and (win, item_id as string)."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    w = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, F.lit(window)))).alias("words")).distinct()
    w = cut(w, "item-windows")
    wins = cut(w.select("words").distinct().select(F.monotonically_increasing_id().alias("win"), "words"), "windows")
    return wins, cut(w.join(wins, "words").select("win", "item_id"), "window-items")


def indexed(docs: DataFrame, phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index of docs (doc_id, text): the postings (term, doc, pos) of all terms of phrases (words), as a table, and (term, n), their counts.

    Postings stay in the order of the documents, which needs no shuffle; the columns of a table file compress well so.
    """
    terms = cut(phrases.select(F.explode("words").alias("term")).select(F.lower("term").alias("term")).distinct(), "terms")
    postings = cut(places(docs).join(terms, "term").select("term", "doc", "pos"), "postings")
    return postings, cut(postings.groupBy("term").agg(F.count("*").alias("n")), "term-counts")


def rare_terms(counts: DataFrame, phrases: DataFrame, rarest: int) -> DataFrame:
    """(term, win, offset, needed): the rarest terms of each phrase (win, words) by counts, and how many different places of the phrase were chosen."""
    own = phrases.select("win", F.posexplode(F.transform("words", lambda x: F.lower(x))).alias("offset", "term"))
    ranked = own.join(counts, "term", "left").groupBy("win").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "offset", "term"))).alias("t"))
    # a phrase with a term that no document has stands nowhere
    ranked = ranked.where(F.col("t")[0]["n"] > 0).select("win", F.slice("t", 1, rarest).alias("t"))
    return cut(ranked.select("win", F.size("t").alias("needed"), F.explode("t").alias("t")).select("t.term", "win", "t.offset", "needed"), "rare-terms")


def phrase_matches(index: tuple[DataFrame, DataFrame], wins: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(doc, found array<struct<win, start, words>>): where windows may stand in each document, by intersection of shifted posting lists."""
    postings, counts = index
    hit = postings.join(rare_terms(counts, wins, rarest), "term")
    at = hit.select("doc", "win", (F.col("pos") - F.col("offset")).alias("start"), "offset", "needed").where("start >= 0")
    both = at.groupBy("doc", "win", "start").agg(F.count_distinct("offset").alias("n"), F.max("needed").alias("needed")).where("n = needed")
    full = both.join(wins, "win")
    return full.groupBy("doc").agg(F.collect_list(F.struct("win", "start", "words")).alias("found"))


def item_words(items: DataFrame) -> DataFrame:
    """(win, item_id, words): the different words of each item (item_id, text) that has any, in order."""
    whole = items.select("item_id", F.array_distinct(words(F.col("text"))).alias("words")).where("size(words) > 0")
    return cut(whole.select(F.monotonically_increasing_id().alias("win"), "item_id", "words"), "items")


def near_matches(index: tuple[DataFrame, DataFrame], whole: DataFrame, span: int = SPAN, rarest: int = NEAR_TERMS) -> DataFrame:
    """(doc, win, start): the first stretch of span words of a document that holds the rarest terms of an item of item_words(), in any order."""
    postings, counts = index
    hit = postings.join(rare_terms(counts, whole, rarest), "term")
    stretch = Window.partitionBy("doc", "win").orderBy("pos").rangeBetween(0, span - 1)
    near = hit.withColumn("near", F.size(F.collect_set("offset").over(stretch))).where("near = needed")
    return near.groupBy("doc", "win").agg(F.min("pos").alias("start"))


def proximity_matches(docs: DataFrame, items: DataFrame, span: int = SPAN, rarest: int = NEAR_TERMS) -> DataFrame:
    """(doc_id, item_id, start): first word of a stretch of span words that holds the item's rarest terms, in any order. Items without words match nothing."""
    whole = item_words(items)
    near = near_matches(indexed(docs, whole), whole, span, rarest).join(whole.select("win", "item_id"), "win")
    return docs.select("doc_id", document_key().alias("doc")).join(near, "doc").select("doc_id", "item_id", "start")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = (), proximity: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, *keep) for every row of docs (doc_id, text).

    A word is hit if it lies in an occurrence of a window of an item (item_id, text): window consecutive words, or all of an item that has fewer, but some.
    Null texts and items have no words; a null item_id is no item of the list, but its windows hit. Repeated rows are judged each for itself. keep: columns of docs to carry.
    proximity: also n_near, the number of items whose NEAR_TERMS rarest terms stand within SPAN words of the document; it decides nothing.
    """
    wins, of_items = benchmark_windows(items, window)
    whole = item_words(items)
    index = indexed(docs.select("doc_id", "text"), whole.select("words"))
    both = docs.select(*dict.fromkeys(["doc_id", "text", *keep]), document_key().alias("doc")).join(phrase_matches(index, wins), "doc", "left")
    stands = let(words(F.col("text")), lambda w: F.filter("found", lambda f: F.slice(w, (f["start"] + 1).cast("int"), F.size(f["words"])) == f["words"]))
    hits = F.when(F.col("found").isNotNull() & F.col("text").isNotNull(), F.transform(stands, lambda f: F.struct(f["win"].alias("win"), f["start"].alias("start"), F.size(f["words"]).alias("n"))))
    n_words = F.coalesce(F.regexp_count("text", F.lit(ALNUM_WORD)), F.lit(0)).cast("long")
    each = both.select("doc_id", *keep, "doc", n_words.alias("n_words"), F.coalesce(hits, F.array().cast("array<struct<win:bigint,start:int,n:int>>")).alias("hits"), F.monotonically_increasing_id().alias("row"))
    each = cut(each, "hits")
    drop(wins)
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1))))).cast("long")
    listed = each.select("row", F.explode(F.array_distinct(F.transform("hits", lambda h: h["win"]))).alias("win")).join(of_items, "win")
    listed = listed.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = each.withColumn("n_hit", covered).join(listed, "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    near = []
    if proximity:
        counted = cut(near_matches(index, whole).groupBy("doc").agg(F.count("*").alias("n_near")), "near")
        out, near = out.join(counted, "doc", "left"), [F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near")]
    drop(*index)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), *near, *[c for c in keep if c != "doc_id"])


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of an item stands; columns as they are, whatever their names. What is left in the scratch folder is the table of the contaminated documents' keys."""
    with noted() as made:
        keyed = docs.select("doc_id", "text", document_key().alias("key"))
        bad = cut(contamination(keyed, items, window, ("key",)).where("contaminated").select("key").distinct(), "contaminated")
        remove(docs.sparkSession, *[path for path in made if path != bad.scratch_path])
    rows = docs.select(document_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"))
    return rows.join(bad, "key", "left_anti").select("whole_row.*")
