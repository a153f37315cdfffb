"""Boxes: overlaps, best matches, anti-joins with a running set, and line grouping."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkloom.functions.patterns import either
from inkloom.operators.blocks import PAGE

# Sounds that stand alone as labels, and letters.
LABELS = """whisper sob shock jaka sfx bam bang boom thud clap rustle slam tap tch ugh huh hey yeah jolt gasp slap wobble yawn sposh flash
    tremble fidget twitch fwooo woosh crash nod scribble"""
SFX_LABEL = rf"(?i)^(?:{either(LABELS)})[.!?:, -]*$"
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿぁ-んァ-ン一-龯々]"
# End of the fixed values.


def polygon_box(polygon: Column) -> Column:
    """x1, y1, x2, y2 of a polygon, truncated to integers."""
    x, y = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.array(*(c.cast("int") for c in (F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))))


def intersection(a: Column, b: Column) -> Column:
    side = lambda i: F.greatest(F.lit(0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    return side(0) * side(1)


def area(a: Column, least: int = 0) -> Column:
    return F.greatest(F.lit(least), a[2] - a[0]) * F.greatest(F.lit(least), a[3] - a[1])


def iou(a: Column, b: Column, least: int = 0) -> Column:
    """Intersection over union, 0 for boxes apart; sides count ``least`` or more."""
    i = intersection(a, b)
    union = area(a, least) + area(b, least) - i
    return F.when((i <= 0) | (union <= 0), 0.0).otherwise(i / union)


def smaller_overlap(a: Column, b: Column) -> Column:
    return intersection(a, b) / F.greatest(F.lit(1), F.least(area(a, 1), area(b, 1)))


def x_overlap(a: Column, b: Column) -> Column:
    wide = lambda c: F.greatest(F.lit(1), c[2] - c[0])
    return F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) / F.least(wide(a), wide(b))


def vertical_gap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), b[1] - a[3], a[1] - b[3])


def best_match(targets: DataFrame, found: DataFrame, least: float = 0.35) -> DataFrame:
    """Each target with the box of its page that overlaps it most (the first on ties), or null if none reaches ``least``.

    ``targets`` and ``found``: project_id, page_index, block_id, bbox, seq.
    Pages are joined by key and the overlap filters the pairs, so a page's
    boxes meet only each other.
    """
    t = targets.select(*PAGE, F.col("block_id").alias("target_id"), F.col("bbox").alias("_a"))
    c = found.select(*PAGE, F.col("block_id").alias("matched_id"), F.col("bbox").alias("_b"), F.col("seq").alias("_seq"))
    pairs = t.join(c, [*PAGE]).where(intersection(F.col("_a"), F.col("_b")) > 0).withColumn("bbox_iou", iou(F.col("_a"), F.col("_b")))
    best = F.row_number().over(W.partitionBy(*PAGE, "target_id").orderBy(F.desc("bbox_iou"), "_seq"))
    best_pairs = pairs.withColumn("_rn", best).where("_rn = 1").select(*PAGE, "target_id", "matched_id", "bbox_iou")
    x = t.drop("_a").join(best_pairs, [*PAGE, "target_id"], "left").withColumn("bbox_iou", F.coalesce("bbox_iou", F.lit(0.0)))
    return x.withColumn("matched_id", F.when(F.col("bbox_iou") >= least, F.col("matched_id")))


def _boxes_iou(a, b) -> tuple[float, float]:
    side = lambda i: max(0, min(a[i + 2], b[i + 2]) - max(a[i], b[i]))
    both = side(0) * side(1)
    size = lambda c: max(1, c[2] - c[0]) * max(1, c[3] - c[1])
    return (both / (size(a) + size(b) - both), both / min(size(a), size(b))) if both else (0.0, 0.0)


def supplement(kept: DataFrame, rescued: DataFrame) -> DataFrame:
    """Rescued boxes that overlap no kept box and no earlier rescued one, with new ids.

    Both: project_id, page_index, block_id, bbox, seq. A page is one group:
    its boxes are few, and each decision depends on the ones before.
    """
    both = kept.select(*PAGE, "block_id", "bbox", "seq", F.lit(0).alias("_new")).unionByName(rescued.select(*PAGE, "block_id", "bbox", "seq", F.lit(1).alias("_new")))

    def page(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["_new", "seq"], kind="stable")
        boxes, keep, ids = [], [], []
        for new, box in zip(p["_new"], p["bbox"]):
            overlaps = [_boxes_iou(box, other) for other in boxes] if new else []
            ok = not any(max(i, m) >= 0.85 or i >= 0.70 for i, m in overlaps)
            if ok:
                boxes.append(box)
            keep.append(bool(new) and ok)
            ids.append(f"p{p['page_index'].iloc[0]:04d}_s{sum(keep) - 1:04d}")
        return p.assign(block_id=ids)[keep][["project_id", "page_index", "block_id", "bbox", "seq"]]

    return both.groupBy(*PAGE).applyInPandas(page, "project_id string, page_index int, block_id string, bbox array<int>, seq long")


def noise(text: Column, confidence: Column, least: float = 0.20) -> Column:
    """A fragment that is no text: empty, unsure, one character, or without letters.

    Searches that stop at the first, the second or the third letter decide, so
    texts are neither rewritten nor counted through; a text of one character is
    one letter between blanks, as others have no letters.
    """
    other = f"[^{LETTER[1:]}*+"
    one, three = rf"(?U)\A\s*+{LETTER}\s*+\z", other.join([LETTER] * 3)
    return F.coalesce(confidence < least, F.lit(False)) | ~text.rlike(LETTER) | text.rlike(one) | F.coalesce((confidence < 0.55) & ~text.rlike(three), F.lit(False))


def sfx_label(text: Column) -> Column:
    """A sound that stands alone, with marks at its end."""
    from inkloom.functions.text import squeeze

    return squeeze(text).rlike(SFX_LABEL)


def post_process(found: DataFrame, *, least: float = 0.20, filter_noise: bool = True, merge_lines: bool = True, word_rules=(), context_rules=()) -> DataFrame:
    """Recognised fragments (project_id, page_index, seq, polygon, source_lang, ocr_text, confidence) as blocks.

    Texts are normalised (a hyphen at a line's end stays, where lines are
    joined), noise goes if ``filter_noise``, and lines are joined into blocks;
    without joining, blocks follow each other down the page. Ids number the
    fragments of a page as they came, noise included.
    """
    from inkloom.operators.normalise import normalise

    at = F.row_number().over(W.partitionBy(*PAGE).orderBy("seq")) - 1
    x = normalise(found.withColumn("_at", at), word_rules=word_rules, context_rules=context_rules)
    if merge_lines:
        cut = F.col("ocr_text").rlike(r"[A-Za-z]-\s*$") & F.col("normalised").endswith("...")
        x = x.withColumn("normalised", F.when(cut, F.regexp_replace("normalised", r"\.\.\.$", "-")).otherwise(F.col("normalised")))
    if filter_noise:
        x = x.where(~noise(F.col("normalised"), F.col("confidence"), least))
    x = x.select(*PAGE, F.format_string("p%04d_b%04d", F.col("page_index"), F.col("_at")).alias("block_id"), polygon_box(F.col("polygon")).alias("bbox"), "source_lang", F.col("normalised").alias("ocr_text"), "confidence", "_at")
    if merge_lines:
        return group_lines(x.drop("_at"))
    cx, cy = F.col("bbox")[0] + F.col("bbox")[2], F.col("bbox")[1] + F.col("bbox")[3]
    order = W.partitionBy(*PAGE).orderBy(cy, F.when(F.col("source_lang") == "ja", -cx).otherwise(cx), "_at")
    return x.withColumn("reading_order", F.row_number().over(order) - 1).withColumn("n_lines", F.lit(1)).drop("source_lang", "_at")


def group_lines(lines: DataFrame, *, keep: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """Lines of a page joined into blocks: each line, in reading order, goes to the group that it fits best.

    ``lines``: project_id, page_index, block_id, bbox, source_lang, ocr_text,
    confidence; lines of one place are taken by ``seq``, if there is one. A block
    has the columns ``keep`` of its first line. Sound labels never join other
    text. Every choice depends on the groups of the page so far, so pages stream
    through Arrow one after the other; ``dealt``: each page lies in one partition already.
    """
    rows = lines if dealt else lines.repartition(*PAGE)
    order = [*PAGE, "seq"] if "seq" in lines.columns else [*PAGE]
    taken = list(dict.fromkeys([*PAGE, "block_id", "bbox", "source_lang", "ocr_text", "confidence", *keep]))
    kinds = "".join(f", {c} {lines.schema[c].dataType.simpleString()}" for c in keep)
    schema = "project_id string, page_index int, block_id string, bbox array<int>, ocr_text string, confidence double, reading_order int, n_lines int" + kinds
    names = ["project_id", "page_index", "block_id", "bbox", "ocr_text", "confidence", "reading_order", "n_lines", *keep]
    fixed = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.float64(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, blocks = None, []
        at = {c: i for i, c in enumerate(taken)}

        def lines_of() -> Iterator[tuple]:
            nonlocal types
            for batch in batches:
                types = types or [*fixed, *(batch.schema.field(c).type for c in keep)]
                yield from zip(*(batch.column(c).to_pylist() for c in taken))

        def made() -> pa.RecordBatch:
            columns = zip(*blocks)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], names)

        for key, page in groupby(lines_of(), key=lambda r: r[:2]):
            page = list(page)
            found = [dict(box=r[at["bbox"]], text=r[at["ocr_text"]], conf=r[at["confidence"]], id=r[at["block_id"]], keep=[r[at[c]] for c in keep]) for r in page]
            blocks += ((*key, *b) for b in page_groups(found, page[0][at["source_lang"]] == "ja"))
            if len(blocks) >= 5_000:
                yield made()
                blocks = []
        if blocks:
            yield made()

    return rows.select(*taken, *(c for c in order if c not in taken)).sortWithinPartitions(*order).mapInArrow(run, schema)


IS_LABEL, LATIN = re.compile(SFX_LABEL), re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]")


def page_groups(rows: list[dict], ja: bool) -> Iterator[tuple]:
    """Of one page's lines (box, text, conf, id, keep): id, box, text, confidence, order, number of lines and what is kept of each group.

    Lines come down the page, so a group that lies too far above one for any of
    the heights to come is out of reach of all later lines, and isn't tried again.
    """
    place = lambda r: (r["box"][1] + r["box"][3], (-1 if ja else 1) * (r["box"][0] + r["box"][2]))
    tall = lambda b: max(1, b[3] - b[1])
    wide = lambda b: max(1, b[2] - b[0])
    for r in rows:
        r["text"] = " ".join(r["text"].split())
        r["sfx"] = bool(IS_LABEL.match(r["text"]))
    rows = sorted(rows, key=place)
    # the greatest height from each line on
    most = list(accumulate((tall(r["box"]) for r in reversed(rows)), max))[::-1]

    def fit(g: dict, r: dict) -> float | None:
        if g["sfx"] != r["sfx"]:
            return None
        a, b = g["box"], r["box"]
        gap = max(0, b[1] - a[3], a[1] - b[3])
        if gap > max(34, 1.45 * (g["tall"] + tall(b)) / (len(g["rows"]) + 1)):
            return None
        off = abs(a[0] + a[2] - b[0] - b[2]) / 2
        allow = 0.85 * max(wide(a), wide(b))
        share = max(0, min(a[2], b[2]) - max(a[0], b[0])) / min(wide(a), wide(b))
        if share >= 0.18:
            return 100 * share - 18 * off / max(1.0, allow) - 0.2 * gap
        return 24 - 20 * off / max(1.0, allow) - 0.2 * gap if off <= max(45, allow) else None

    def reached(g: dict, r: dict, high: int) -> bool:
        """Whether r or a later line, of a height up to ``high``, can be near enough: its top is half of that above its middle at most, and no mean of heights exceeds both."""
        middle = (r["box"][1] + r["box"][3]) / 2
        return middle - high / 2 - g["box"][3] <= max(34, 1.45 * max(high, g["tall"] / len(g["rows"]))) + 1

    groups: list[dict] = []
    near: list[dict] = []
    for r, high in zip(rows, most):
        near = [g for g in near if reached(g, r, high)]
        fits = [(s, -k) for k, g in enumerate(near) if (s := fit(g, r)) is not None]
        if fits:
            g = near[-max(fits)[1]]
            g["rows"].append(r)
            g["tall"] += tall(r["box"])  # added up as lines come: a sum anew for every line makes long pages quadratic
            g["box"] = [min(g["box"][0], r["box"][0]), min(g["box"][1], r["box"][1]), max(g["box"][2], r["box"][2]), max(g["box"][3], r["box"][3])]
        else:
            groups.append({"rows": [r], "box": r["box"], "sfx": r["sfx"], "tall": tall(r["box"])})
            near.append(groups[-1])
    # groups begin in the order of their first lines
    for order, g in enumerate(groups):
        texts = [r["text"] for r in g["rows"] if r["text"]]
        close = ja and not any(map(LATIN.search, texts))
        known = [r["conf"] for r in g["rows"] if r["conf"] is not None and r["conf"] == r["conf"]]
        first = g["rows"][0]
        yield (first["id"], g["box"], ("" if close else " ").join(texts), sum(known) / len(known) if known else None, order, len(g["rows"]), *first["keep"])
