"""Search, personal data, entities and redaction on text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyra.functions.patterns import NEEDED, PATTERNS, escaped, select
from papyra.functions.scalars import let, luhn, match_spans

#: Fixed values, in order; the first that a sentence contains, as a substring, is its detail.
PRONOUNS = (
    "he", "she", "they", "him", "her", "them", "his", "their",
    "the patient", "the client", "the employee", "the applicant", "the individual", "the person", "the subject",
)


def possible(category: str, pattern: str, text: Column) -> Column:
    """False where the text has not even what each match of the category needs."""
    if PATTERNS.get(category) != pattern:
        return F.lit(True)
    need = F.contains(text, F.lit(NEEDED[category])) if category == "email" else text.rlike(NEEDED[category])
    return F.coalesce(need, F.lit(False))


def matches(docs: DataFrame, categories: dict[str, str] | None = None, *columns: str) -> DataFrame:
    """(doc_id, columns, category, start, end, text): all matches; cards only with a right check digit. Narrow: one pass, no join."""
    categories = categories or PATTERNS

    def under(category: str, pattern: str) -> Column:
        return F.transform(F.when(possible(category, pattern, F.col("text")), match_spans(F.col("text"), pattern)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,text:string>>")), lambda s: F.struct(F.lit(category).alias("category"), s.start.alias("start"), s.end.alias("end"), s.text.alias("text")))

    each = [under(k, p) for k, p in categories.items()]
    # no match is without a digit, a colon or an at sign, where the expressions are the catalogue's
    bare = docs.filter(F.col("text").rlike("[0-9:@]")) if all(PATTERNS.get(k) == p for k, p in categories.items()) else docs
    rows = bare.select("doc_id", *columns, F.explode(F.flatten(F.array(*each))).alias("m")).select("doc_id", *columns, "m.*")
    return rows.filter((F.col("category") != "credit_card") | luhn(F.col("text")))


def ordered(found: DataFrame) -> DataFrame:
    """Matches numbered within a document by start, the longest first."""
    w = W.partitionBy("doc_id").orderBy("start", F.desc("end"), "category")
    return found.withColumn("ord", F.row_number().over(w))


def search(docs: DataFrame, query: str, whole_word: bool = False, match_case: bool = False) -> DataFrame:
    """(doc_id, start, length) of a literal, not overlapping."""
    p = escaped(query if match_case else query.lower())
    p = rf"\b{p}\b" if whole_word else p
    text = F.col("text") if match_case else F.lower("text")
    return docs.select("doc_id", F.explode(match_spans(text, p)).alias("m")).select("doc_id", F.col("m.start").alias("start"), F.length("m.text").cast("long").alias("length"))


def word_pattern(words: list[str], regex: bool = False, whole_word: bool = False, match_case: bool = False) -> str:
    """One alternation, the longest words first; blank words are skipped."""
    parts = sorted({w if regex else escaped(w) for w in words if w and w.strip()}, key=lambda w: (-len(w), w))
    if not parts:
        raise ValueError("nothing to redact")
    p = "|".join(parts)
    p = rf"\b(?:{p})\b" if whole_word else f"(?:{p})"
    return p if match_case else "(?i)" + p


def redact(docs: DataFrame, pattern: str | Column, mask: str = "█") -> DataFrame:
    """docs with every match covered, character by character, and n_redacted."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    both = F.struct(F.regexp_extract_all("text", pattern, F.lit(0)).alias("found"), F.split("text", pattern, -1).alias("between"))
    put = lambda a, m: F.concat(a, F.coalesce(F.repeat(F.lit(mask), F.length(m)), F.lit("")))
    covered = let(both, lambda s: F.struct(F.size(s["found"]).cast("long").alias("n"), F.array_join(F.zip_with(s["between"], s["found"], put), "").alias("text")))
    done = docs.withColumn("__covered", covered)
    return done.withColumns({"n_redacted": F.col("__covered.n"), "text": F.col("__covered.text")}).drop("__covered")


def entities(docs: DataFrame, dictionary: dict[str, str]) -> DataFrame:
    """(doc_id, start, end, keyword, label): the longest registered keyword at each place, bounded by ASCII letters and digits."""
    by_key: dict[str, tuple[str, str]] = {}
    for word, label in dictionary.items():
        by_key[word.lower()] = (word, label)
    alternatives = "|".join(escaped(k) for k in sorted(by_key, key=lambda k: (-len(k), k)))
    found = docs.select("doc_id", F.explode(match_spans(F.lower("text"), f"(?<![a-z0-9])(?:{alternatives})(?![a-z0-9])")).alias("m"))
    lookup = F.create_map(*[F.lit(x) for k, v in by_key.items() for x in (k, "\t".join(v))])
    hit = F.split(F.element_at(lookup, F.col("m.text")), "\t")
    return found.select("doc_id", F.col("m.start").alias("start"), F.col("m.end").alias("end"), hit[0].alias("keyword"), hit[1].alias("label"))


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence, start, end, text): up to and with a full stop, question or exclamation mark and the space after it."""
    return docs.select("doc_id", F.posexplode(match_spans(F.col("text"), r"[^.!?]+[.!?]*\s*|[.!?]+\s*")).alias("sentence", "m")).select("doc_id", "sentence", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.text").alias("text"))


def coreferences(sentences: DataFrame, entities: DataFrame, window: int = 2) -> DataFrame:
    """(doc_id, sentence, detail): sentences within a window of one that holds an entity, without one themselves, that contain a pronoun."""
    hits = entities.select("doc_id", F.col("start").alias("at"))
    seeds = sentences.join(hits, "doc_id").filter((F.col("at") >= F.col("start")) & (F.col("at") < F.col("end"))).select("doc_id", "sentence").distinct().withColumn("seed", F.lit(True))
    near = W.partitionBy("doc_id").orderBy("sentence").rangeBetween(-window, window)
    marked = sentences.join(seeds, ["doc_id", "sentence"], "left").withColumn("near", F.max(F.coalesce("seed", F.lit(False))).over(near))
    lowered = F.lower("text")
    detail = F.coalesce(*[F.when(F.contains(lowered, F.lit(p)), F.lit(p)) for p in PRONOUNS])
    return marked.filter("near and seed is null").withColumn("detail", detail).filter("detail is not null").select("doc_id", "sentence", "detail")


def region_hit(box: dict[str, Column], region: dict[str, Column], share: float = 0.7) -> Column:
    """Is more than a share of a box's area, or all of it, inside a region?"""
    wide = F.greatest(F.lit(0.0), F.least(box["x"] + box["w"], region["x"] + region["w"]) - F.greatest(box["x"], region["x"]))
    high = F.greatest(F.lit(0.0), F.least(box["y"] + box["h"], region["y"] + region["h"]) - F.greatest(box["y"], region["y"]))
    area = box["w"] * box["h"]
    return (area > 0) & (wide * high > share * area)


@dataclass(frozen=True)
class Options:
    """What a redaction does. Blank words are dropped; at least one thing has to be asked for."""

    words: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    dictionary: dict[str, str] = field(default_factory=dict)
    metadata_keys: tuple[str, ...] = ()
    whole_word: bool = False
    match_case: bool = False
    mask: str = "█"

    def __post_init__(self):
        object.__setattr__(self, "words", tuple(w for w in self.words if w and w.strip()))
        if not (self.words or self.categories or self.dictionary or self.metadata_keys):
            raise ValueError("no redaction is asked for")


def run(docs: DataFrame, options: Options) -> DataFrame:
    """docs with the words covered that are asked for, that match a category or that are entities: the union of a document's words, in one pass.

    Card numbers need a right check digit; entities stand between other characters than ASCII letters and digits. n_patterns
    and n_entities count what was found, n_words what was covered, n_redactions all three. Metadata keys concern no text.
    """

    def texts(text: Column, p: str) -> Column:
        return F.regexp_extract_all(text, F.lit(p), F.lit(0))

    text = F.col("text")
    none = F.array().cast("array<string>")
    cards = []
    for k, p in (select(*options.categories).items() if options.categories else ()):
        found = F.when(possible(k, p, text), texts(text, p)).otherwise(none)
        cards.append(F.filter(found, lambda t: luhn(t)) if k == "credit_card" else found)
    named = F.lit(None).cast("array<string>")
    if options.dictionary:
        keys = sorted({k.lower() for k in options.dictionary}, key=lambda k: (-len(k), k))
        named = texts(F.lower(text), f"(?<![a-z0-9])(?:{'|'.join(map(escaped, keys))})(?![a-z0-9])")
    found = docs.withColumns({"__found": F.coalesce(F.flatten(F.array(*cards)), none) if cards else none, "__named": F.coalesce(named, none)})
    words = F.array_distinct(F.concat(F.array(*map(F.lit, options.words)).cast("array<string>"), "__found", "__named"))
    longest = F.array_sort(words, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    pattern = F.array_join(F.transform(longest, lambda w: F.regexp_replace(w, r"([\\.\[\]{}()*+?^$|])", r"\\$1")), "|")
    edge, flag = r"\b" if options.whole_word else "", "" if options.match_case else "(?i)"
    ready = found.withColumn("__pattern", F.when(F.size(words) > 0, F.concat(F.lit(f"{flag}{edge}(?:"), pattern, F.lit(f"){edge}"))).otherwise(F.lit(r"(?!)")))
    out = redact(ready, F.col("__pattern"), options.mask).withColumns({"n_words": F.coalesce("n_redacted", F.lit(0).cast("long")), "n_patterns": F.size("__found").cast("long"), "n_entities": F.size("__named").cast("long")})
    return out.withColumn("n_redactions", F.col("n_words") + F.col("n_patterns") + F.col("n_entities")).drop("n_redacted", "__found", "__named", "__pattern")


# -- pending marks


def mark(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, mark, start, end): what a commit would cover; nothing is changed."""
    return docs.select("doc_id", F.posexplode(match_spans(F.col("text"), pattern)).alias("mark", "m")).select("doc_id", "mark", F.col("m.start").alias("start"), F.col("m.end").alias("end"))


def unmark(marks: DataFrame, removed: DataFrame) -> DataFrame:
    return marks.join(removed.select("doc_id", "mark"), ["doc_id", "mark"], "left_anti")


def commit(docs: DataFrame, marks: DataFrame, mask: str = "█") -> DataFrame:
    """docs with the marked ranges covered, and n_committed. A document's marks meet it as one array."""
    spans = marks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    joined = docs.join(spans, "doc_id", "left")
    put = lambda t, s: F.concat(F.substring(t, F.lit(1), s.start.cast("int")), F.repeat(F.lit(mask), (s.end - s.start).cast("int")), F.substring(t, (s.end + 1).cast("int"), F.length(t)))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.aggregate("spans", F.col("text"), put))
    return joined.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_committed"))


def sanitise(objects: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Objects (doc_id, kind, …) without these kinds, and an audit (doc_id, kind, n) of what went."""
    gone = F.col("kind").isin(kinds)
    return objects.filter(~gone), objects.filter(gone).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))
