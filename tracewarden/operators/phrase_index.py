"""Phrase lists of any length: an inverted index over grams, joined with the grams of the texts and verified.

Each phrase is filed under one of its grams, the one that fewest phrases have. A text is cut into chunks that overlap by the
longest phrase, so every occurrence starts in exactly one chunk. The grams of a chunk first pass a bit table of fixed
size, which is broadcast; what is left is joined with the index, and the phrase is compared byte by byte where it would
have to stand. Neither phrases nor rules reach the driver or become literals of the plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.functions.transforms import apply_chain, chain_prefixes, effective_chain
from tracewarden.session import bounded_rows, stored

#: Bytes of a gram; a shorter phrase is its own gram.
GRAM = 4
#: Positions of a phrase, evenly spread, among which its gram is chosen. Any choice finds the same occurrences.
GRAM_CHOICES = 64
#: Bytes of text in which the occurrences of one chunk start; as many as the longest phrase has if that is more.
CHUNK = 256
#: The bit table has 2^18 words of 64 bits: at most 4 MB are broadcast, however many phrases there are.
WORD_BITS = 18
#: Phrase rules, by list, that are broadcast; more are joined with this many parts of the texts.
MOST_SENT, SALTS = 10_000, 64
#: Different transform chains, and pairs of chain and collection, of one rule table.
MOST_CHAINS = 1000


def folded(text: Column) -> Column:
    """The form in which phrases are compared: bytes of the lower-cased text."""
    return F.lower(text).cast("binary")


def phrase_index(phrases: DataFrame) -> DataFrame:
    """``(phrase, size, at, gram)``: each distinct folded phrase with its rarest gram and the place of that gram in it.

    Null phrases are left out. An empty phrase is kept: it occurs in every text.
    """
    size = F.length("phrase")
    width = F.least(size, F.lit(GRAM))
    last = size - width
    step = F.floor(last / GRAM_CHOICES).cast("int") + 1
    grams = (
        phrases.select(folded(F.col("phrase")).alias("phrase"))
        .filter("phrase IS NOT NULL")
        .distinct()
        .select("phrase", F.explode(F.sequence(F.lit(0), last, step)).alias("at"))
        .withColumn("gram", F.xxhash64(F.substring("phrase", F.col("at") + 1, width)))
    )
    owners = grams.groupBy("gram").agg(F.count("*").alias("owners"))
    chosen = grams.join(owners, "gram").groupBy("phrase").agg(F.min(F.struct("owners", "at", "gram")).alias("best"))
    return chosen.select("phrase", size.alias("size"), "best.at", "best.gram")


def _word(gram: Column) -> Column:
    return F.shiftrightunsigned(gram, 64 - WORD_BITS)


def _bit(gram: Column) -> Column:
    return F.pmod(gram, F.lit(64)).cast("int")


def bit_table(index: DataFrame) -> DataFrame:
    """The grams of the index as set bits, 64 to a row."""
    placed = index.select(_word(F.col("gram")).alias("word"), _bit(F.col("gram")).alias("bit"))
    return placed.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def _text_grams(texts: DataFrame, widths: list[int], longest: int) -> DataFrame:
    """``(text_id, chunk, place, gram)`` for every place of every chunk."""
    length = F.length("text")
    span = max(CHUNK, longest)
    chunks = texts.select("text_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(span))).alias("from"))
    chunks = chunks.select("text_id", F.substring("text", F.col("from") + 1, F.lit(span + longest)).alias("chunk"))
    places = chunks.select("text_id", "chunk", F.explode(F.sequence(F.lit(0), F.greatest(F.length("chunk") - 1, F.lit(0)))).alias("place"))

    def gram(width: int) -> Column:
        there = F.col("place") + width <= F.length("chunk") if width else F.col("place") == 0
        return F.when(there, F.xxhash64(F.substring("chunk", F.col("place") + 1, F.lit(width))))

    if len(widths) == 1:
        return places.withColumn("gram", gram(widths[0])).filter("gram IS NOT NULL")
    return places.withColumn("gram", F.explode(F.array_compact(F.array(*map(gram, widths)))))


def find_phrases(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """Distinct ``(text_id, phrase)``: the folded phrases that occur in ``(text_id, text)``, ``text`` folded.

    A phrase may stand anywhere and overlap others. A gram that many texts have is split by Spark's skew join; only rows
    past the bit table shuffle.
    """
    return _occurrences(texts, stored(phrase_index(phrases), "phrase-index"), "phrase")


def find_lists(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """Distinct ``(text_id, list)``: the lists of ``(list, phrase)`` of which any phrase occurs, as ``find_phrases`` finds them.

    Phrases meet their lists in the index. A text with many phrases of a list leaves its task as one row, and a phrase that
    most texts hold gathers nothing.
    """
    by_list = lists.select("list", folded(F.col("phrase")).alias("phrase")).distinct()
    return _occurrences(texts, stored(phrase_index(lists).join(by_list, "phrase"), "phrase-index"), "list")


def _occurrences(texts: DataFrame, index: DataFrame, what: str) -> DataFrame:
    """Distinct ``(text_id, <what>)`` of the index rows whose phrase occurs."""
    widths = F.sort_array(F.collect_set(F.least("size", F.lit(GRAM))))
    longest, widths = index.agg(F.max("size"), widths).first()
    if not widths:
        return texts.select("text_id", F.col("text").cast(index.schema[what].dataType).alias(what)).limit(0)
    grams = _text_grams(texts.filter("text IS NOT NULL"), widths, longest).withColumn("word", _word(F.col("gram")))
    bits = F.broadcast(bit_table(index))
    possible = grams.join(bits, "word").filter(F.getbit("bits", _bit(F.col("gram"))) == 1).drop("word", "bits")
    start = F.col("place") - F.col("at")
    here = (start >= 0) & (start < max(CHUNK, longest))
    same = F.substring("chunk", start + 1, F.col("size")) == F.col("phrase")
    return possible.join(index, "gram").filter(here & same).select("text_id", what).distinct()


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def is_phrase_rule() -> Column:
    """Rules that ask whether any phrase of a list occurs."""
    plain = ~F.coalesce("negate", F.lit(False)) & ~F.coalesce("is_count", F.lit(False))
    return F.col("operator").isin("pm", "pmFromFile") & plain


def _rule_lists(rules: DataFrame) -> DataFrame:
    """``rules`` once per list they name; the words of a rule's own argument are a list called by the argument."""
    own = F.array(F.concat(F.lit("="), F.col("argument")))
    named = F.transform(_words(F.col("argument")), lambda name: F.concat(F.lit("@"), name))
    return rules.withColumn("list", F.explode(F.when(F.col("operator") == "pm", own).otherwise(named)))


def _lists(rules: DataFrame, phrases: DataFrame | None) -> DataFrame:
    """``(list, phrase)`` of the lists that the rules name, phrases folded."""
    own = rules.filter("operator = 'pm'").select(F.concat(F.lit("="), F.col("argument")).alias("list"), F.explode(_words(F.col("argument"))).alias("phrase"))
    if phrases is not None:
        used = _rule_lists(rules.filter("operator = 'pmFromFile'")).select("list").distinct()
        named = phrases.select(F.concat(F.lit("@"), F.col("list_name")).alias("list"), "phrase")
        own = own.unionByName(named.join(used, "list", "left_semi"))
    return own


def _with_rules(held: DataFrame, facts: DataFrame) -> DataFrame:
    """``held`` with the rules of its chain and list. A list that most texts hold must not gather them in one task: few rules go
    to every row, of many a copy goes to each of SALTS parts of the texts."""
    if facts.count() <= MOST_SENT:
        return held.join(F.broadcast(facts), ["chain", "list"])
    copies = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return held.withColumn("salt", F.pmod(F.xxhash64("text_id"), F.lit(SALTS)).cast("int")).join(copies, ["chain", "list", "salt"]).drop("salt")


def phrase_rule_scan(targets: DataFrame, rules: DataFrame, phrases: DataFrame | None, key: str = "req_id") -> DataFrame:
    """``rule_scan`` for phrase rules (``is_phrase_rule``), by joins: rules and lists may be of any number.

    Equal texts are searched once. What a text contains is brought back to its targets, then to the rules of the lists.
    A row that is there several times matches as often.
    """
    spark = targets.sparkSession
    rules = rules.filter(is_phrase_rule())
    # transform chains and the collections each is needed for: as many as there are kinds of rules, not rules
    kinds = rules.select("transforms", "multi_match", F.explode("collections").alias("collection")).distinct()
    wanted: dict[tuple[str, ...], set[str]] = {}
    uses = []
    for kind in bounded_rows(kinds, MOST_CHAINS, "transform chains of phrase rules"):
        steps, multi = kind["transforms"], bool(kind["multi_match"])
        for chain in chain_prefixes(steps) if multi else [effective_chain(steps)]:
            wanted.setdefault(chain, set()).add(kind["collection"])
            uses.append((steps, multi, chain))
    numbers = {chain: i for i, chain in enumerate(sorted(wanted))}
    columns = [key, "collection", "name", "value"]
    if not numbers:
        none = F.lit(0)
        return targets.select(key, none.alias("rule_id"), none.alias("chain_link"), *columns[1:]).limit(0)

    def form(chain: tuple[str, ...], number: int) -> Column:
        text = folded(apply_chain(F.col("value"), chain))
        there = F.col("collection").isin(*sorted(wanted[chain])) & text.isNotNull()
        return F.when(there, F.struct(F.lit(number).alias("chain"), text.alias("text")))

    forms = F.array_compact(F.array(*(form(c, n) for c, n in numbers.items())))
    scanned = targets.filter(F.col("collection").isin(*sorted(reduce(set.union, wanted.values()))))
    rows = scanned.select(*columns, F.explode(forms).alias("form")).select(*columns, "form.chain", "form.text")
    text_id = F.unhex(F.sha2("text", 256)).alias("text_id")
    lists = stored(_lists(rules, phrases), "phrase-lists")
    hits = find_lists(rows.select("text").distinct().select(text_id, "text"), lists)

    kind_of = lambda steps, multi: F.to_json(F.struct(steps.alias("t"), F.coalesce(multi, F.lit(False)).alias("m")))
    chains = spark.createDataFrame(sorted({(s, m, numbers[c]) for s, m, c in ((tuple(s) if s is not None else None, m, c) for s, m, c in uses)}, key=str), "t array<string>, m boolean, chain int")
    chains = chains.select(kind_of(F.col("t"), F.col("m")).alias("kind"), "chain")
    facts = _rule_lists(rules).select(
        "rule_id",
        F.coalesce("chain_link", F.lit(0)).alias("chain_link"),
        "list",
        F.col("collections").alias("__in"),
        F.col("name_filter").alias("__filter"),
        F.col("excluded").alias("__out"),
        kind_of(F.col("transforms"), F.col("multi_match")).alias("kind"),
    )
    facts = facts.join(F.broadcast(chains), "kind").drop("kind")
    out = F.exists("__out", lambda o: (o["collection"] == F.col("collection")) & F.rlike(F.col("name"), o["name"]))
    scope = (
        F.array_contains("__in", F.col("collection"))
        & (F.col("__filter").isNull() | (F.col("__filter") == "") | F.rlike(F.col("name"), F.col("__filter")))
        & (F.col("__out").isNull() | ~out)
    )
    match = [key, "rule_id", "chain_link", "collection", "name", "value"]
    held = rows.select(*columns, "chain", text_id).join(hits, "text_id")
    matched = _with_rules(held, stored(facts, "phrase-rules")).filter(scope)
    # equal targets have the same hits, so each way (chain, list) to a match counts the equal targets
    ways = matched.groupBy(*match, "chain", "list").agg(F.count("*").alias("__n"))
    times = ways.groupBy(*match).agg(F.max("__n").cast("int").alias("__n"))
    return times.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*match)
