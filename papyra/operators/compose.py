"""Page composition: everything is arithmetic over (doc_id, page_index) rows; order is a column, never a position in a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAPERS = {"A0": (2384, 3370), "A1": (1684, 2384), "A2": (1191, 1684), "A3": (842, 1191), "A4": (595, 842), "A5": (420, 595), "LETTER": (612, 792), "LEGAL": (612, 1008), "TABLOID": (792, 1224)}
#: Ranges of documents whose page counts are summed apart.
BUCKETS = 128
POSITIONS = [f"{v}_{h}" for v in ("TOP", "MIDDLE", "BOTTOM") for h in ("LEFT", "CENTER", "RIGHT")]


def split_every(pages: DataFrame, n: int) -> DataFrame:
    if n < 1:
        raise ValueError("n has to be at least 1")
    return pages.withColumns({"part": F.floor(F.col("page_index") / n).cast("int"), "page_in_part": (F.col("page_index") % n).cast("int")})


def split_at(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """pages with part, a running count of the starts (doc_id, page_index) up to each page."""
    s = starts.select("doc_id", "page_index").distinct().withColumn("__start", F.lit(1))
    w = W.partitionBy("doc_id").orderBy("page_index")
    return pages.join(s, ["doc_id", "page_index"], "left").withColumn("part", F.sum(F.coalesce("__start", F.lit(0))).over(w).cast("int")).drop("__start")


def extract(pages: DataFrame, indices: list[int]) -> DataFrame:
    return pages.filter(F.col("page_index").isin(sorted(set(indices))))


def extract_range(pages: DataFrame, first: int, last: int) -> DataFrame:
    if first < 0 or last < first:
        raise ValueError("no such range")
    return pages.filter(F.col("page_index").between(first, last))


def merge(pages: DataFrame, by: str = "doc_id", group: Column | None = None) -> DataFrame:
    """All documents of a group one after the other, in the order of by (a number): new_index.

    Page counts are summed within BUCKETS ranges of by, and over ranges, so that no group's documents meet in one task. The
    ranges' bounds are quantiles; where they lie changes only who sums what.
    """
    keyed = pages.withColumn("__g", group if group is not None else F.lit(0))
    sizes = keyed.groupBy("__g", by).agg(F.count("*").alias("__n"))
    bounds = pages.approxQuantile(by, [i / BUCKETS for i in range(1, BUCKETS)], 0.2 / BUCKETS)
    edges = F.array(*[F.lit(int(b)) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<long>")
    sizes = sizes.withColumn("__b", F.size(F.filter(edges, lambda b: b <= F.col(by))))
    above = W.partitionBy("__g").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)  # over BUCKETS rows at most
    inside = W.partitionBy("__g", "__b").orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.groupBy("__g", "__b").agg(F.sum("__n").alias("__all")).select("__g", "__b", F.coalesce(F.sum("__all").over(above), F.lit(0)).alias("__offset"))
    before = sizes.withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(offsets, ["__g", "__b"]).select("__g", by, (F.col("__offset") + F.col("__in")).alias("__before"))
    return keyed.join(before, ["__g", by]).withColumn("new_index", (F.col("__before") + F.col("page_index")).cast("long")).drop("__g", "__before")


def with_count(pages: DataFrame) -> DataFrame:
    return pages.withColumn("n_pages", F.count("*").over(W.partitionBy("doc_id")))


def reverse(pages: DataFrame) -> DataFrame:
    return with_count(pages).withColumn("new_index", F.col("n_pages") - 1 - F.col("page_index")).drop("n_pages")


def reorder(pages: DataFrame, order: list[int]) -> DataFrame:
    """order[i] is the page that comes to place i: a permutation."""
    if sorted(order) != list(range(len(order))):
        raise ValueError("order is not a permutation")
    place = F.create_map(*[F.lit(x) for i, p in enumerate(order) for x in (p, i)])
    return pages.withColumn("new_index", F.element_at(place, F.col("page_index")))


def swap(pages: DataFrame, a: int, b: int) -> DataFrame:
    """Pages a and b change places; documents without both stay as they are."""
    i, both = F.col("page_index"), F.col("n_pages") > max(a, b)
    return with_count(pages).withColumn("new_index", F.when(both & (i == a), b).when(both & (i == b), a).otherwise(i)).drop("n_pages")


def move_range(pages: DataFrame, first: int, last: int, to: int) -> DataFrame:
    """Takes pages first to last out and puts them before place to of the rest (clamped)."""
    i, n = F.col("page_index"), last - first + 1
    rest = F.when(i > last, i - n).otherwise(i)
    inside = i.between(first, last)
    at = F.least(F.lit(to), F.col("n_pages") - n)
    out = with_count(pages)
    return out.withColumn("new_index", F.when(F.col("n_pages") <= last, i).when(inside, at + i - first).when(rest >= at, rest + n).otherwise(rest)).drop("n_pages")


def interleave(a: DataFrame, b: DataFrame, reverse_second: bool = False) -> DataFrame:
    """Pages of a and b in turn, by page number; the longer one's rest follows. (source, page_index) with ord."""
    second = (reverse(b).withColumn("__i", F.col("new_index")).drop("new_index") if reverse_second else b.withColumn("__i", F.col("page_index"))).withColumn("source", F.lit(1))
    both = a.withColumn("__i", F.col("page_index")).withColumn("source", F.lit(0)).unionByName(second)
    return both.withColumn("ord", F.row_number().over(W.partitionBy("doc_id").orderBy("__i", "source")) - 1).drop("__i")


def booklet(documents: DataFrame, right_binding: bool = False) -> DataFrame:
    """(doc_id, sheet, side, slot, page_index) of documents (doc_id, n_pages): four slots a sheet; null where there is no page."""
    padded = documents.withColumn("p", (F.ceil(F.col("n_pages") / 4) * 4).cast("long"))
    s = F.col("sheet")
    rows = padded.filter("p > 0").select("doc_id", "n_pages", "p", F.explode(F.expr("sequence(0L, p div 4 - 1)")).alias("sheet"))
    front, back = [F.col("p") - 1 - 2 * s, 2 * s], [2 * s + 1, F.col("p") - 2 - 2 * s]
    if right_binding:
        front, back = front[::-1], back[::-1]
    slots = F.array(*[F.struct(F.lit(side).alias("side"), F.lit(i).alias("slot"), page.alias("page")) for side, pair in (("front", front), ("back", back)) for i, page in enumerate(pair)])
    return rows.select("doc_id", "sheet", F.col("n_pages"), F.explode(slots).alias("x")).select("doc_id", "sheet", "x.side", "x.slot", F.when(F.col("x.page") < F.col("n_pages"), F.col("x.page")).alias("page_index"))


def n_up(pages: DataFrame, rows: int, cols: int) -> DataFrame:
    n, i = rows * cols, F.col("page_index")
    return pages.withColumns({"sheet": F.floor(i / n).cast("int"), "row": F.floor((i % n) / cols).cast("int"), "col": (i % cols).cast("int")})


def posterize(pages: DataFrame, paper: str = "A4", overlap: float = 18.0) -> DataFrame:
    """Tiles of pages (width, height) on sheets of a paper: (…, row, col, left, bottom, right, top), rows from the top. One tile where the page fits."""
    tw, th = PAPERS[paper]
    cols, rows = F.greatest(F.ceil(F.col("width") / tw), F.lit(1)), F.greatest(F.ceil(F.col("height") / th), F.lit(1))
    sized = pages.withColumns({"__c": cols.cast("int"), "__r": rows.cast("int")})
    tile_w, tile_h = (F.col("width") + (F.col("__c") - 1) * overlap) / F.col("__c"), (F.col("height") + (F.col("__r") - 1) * overlap) / F.col("__r")
    grid = sized.withColumns({"__w": tile_w, "__h": tile_h}).withColumn("row", F.explode(F.expr("sequence(0, __r - 1)"))).withColumn("col", F.explode(F.expr("sequence(0, __c - 1)")))
    left, top = F.col("col") * (F.col("__w") - overlap), F.col("height") - F.col("row") * (F.col("__h") - overlap)
    out = grid.withColumns({"left": F.greatest(left, F.lit(0.0)), "top": top, "right": F.least(left + F.col("__w"), F.col("width")), "bottom": F.greatest(top - F.col("__h"), F.lit(0.0))})
    return out.drop("__c", "__r", "__w", "__h")


def fit(width: Column, height: Column, paper: tuple[float, float], mode: str) -> dict[str, Column]:
    """Scale and offsets that put a page on a paper, centred. Modes: FIT_PAGE, FIT_WIDTH, FIT_HEIGHT, STRETCH."""
    sx, sy = F.lit(float(paper[0])) / width, F.lit(float(paper[1])) / height
    x, y = {"FIT_PAGE": (F.least(sx, sy), F.least(sx, sy)), "FIT_WIDTH": (sx, sx), "FIT_HEIGHT": (sy, sy), "STRETCH": (sx, sy)}[mode]
    return {"scale_x": x, "scale_y": y, "offset_x": (paper[0] - width * x) / 2, "offset_y": (paper[1] - height * y) / 2}


def margins(left: float, bottom: float, right: float, top: float) -> dict[str, Column]:
    """New sizes of pages (width, height), and how far their content moves. A binding margin is one on the left."""
    return {"width": F.col("width") + left + right, "height": F.col("height") + bottom + top, "shift_x": F.lit(float(left)), "shift_y": F.lit(float(bottom))}


def two_up_split(pages: DataFrame, right_to_left: bool = False) -> DataFrame:
    """Each page's halves as pages of their own."""
    half = F.col("width") / 2
    halves = [F.struct(F.lit(0.0).alias("left"), half.alias("right")), F.struct(half.alias("left"), F.col("width").cast("double").alias("right"))]
    return pages.select("*", F.posexplode(F.array(*(halves[::-1] if right_to_left else halves))).alias("half", "box")).select(*pages.columns, "half", "box.left", "box.right", (F.col("page_index") * 2 + F.col("half")).alias("new_index"))


def mirror(width: Column, height: Column, horizontal: bool = True) -> Column:
    m = (F.lit(-1.0), 0, 0, 1, width, 0) if horizontal else (1, 0, 0, F.lit(-1.0), 0, height)
    return F.array(*[(x if isinstance(x, Column) else F.lit(x)).cast("double") for x in m])


def unrotate(rotation: Column, width: Column, height: Column) -> Column:
    """The matrix that takes a page's quarter turns (0 to 3) into its content; null for none."""
    row = lambda *m: F.array(*[(x if isinstance(x, Column) else F.lit(x)).cast("double") for x in m])
    return F.when(rotation == 1, row(0, -1, 1, 0, 0, width)).when(rotation == 2, row(-1, 0, 0, -1, width, height)).when(rotation == 3, row(0, 1, -1, 0, height, 0))


def stamped(template: str, page: Column, pages: Column, date: str) -> Column:
    """{page}, {pages} and {date}; the date is given, so that a rerun says the same."""
    out = F.replace(F.lit(template), F.lit("{page}"), (page + 1).cast("string"))
    return F.replace(F.replace(out, F.lit("{pages}"), pages.cast("string")), F.lit("{date}"), F.lit(date))


def bates(prefix: str, start: int, digits: int, index: Column) -> Column:
    from papyra.functions.scalars import padded_number

    return F.concat(F.lit(prefix), padded_number(index + start, digits))


def anchor(position: str, width: Column, height: Column, text: Column, size: float, margin: float = 36.0, per_char: float = 0.5) -> dict[str, Column]:
    """Where a text of a position starts, by its estimated width."""
    v, h = position.split("_")
    w = F.length(text) * (size * per_char)
    x = {"LEFT": F.lit(margin), "CENTER": (width - w) / 2, "RIGHT": width - w - margin}[h]
    y = {"TOP": height - margin - size, "MIDDLE": (height - size) / 2, "BOTTOM": F.lit(margin)}[v]
    return {"x": x, "y": y}


def long_image(pages: DataFrame, separator: int = 0, most: int = 200_000_000) -> DataFrame:
    """(doc_id, width, height, fits) of all of a document's pages (width, height in pixels) one under the other."""
    out = pages.groupBy("doc_id").agg(F.max("width").cast("long").alias("width"), (F.sum("height") + separator * (F.count("*") - 1)).cast("long").alias("height"))
    return out.withColumn("fits", F.col("width") * F.col("height") <= most)
