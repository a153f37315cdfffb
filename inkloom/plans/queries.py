"""The engine's queries over the driver's tables. Block views are described in ``inkloom.sources.views``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.functions import detect, text
from inkloom.functions.score import band, queue_risk, with_quality, with_texts
from inkloom.operators import blocks as B
from inkloom.operators import evaluate, geometry, learning, memory, selection
from inkloom.sources import sinks, tables
from inkloom.sources.views import BIG, SMALL, doc_blocks, scratch, sentence_blocks, settled, table, turn_blocks

KEY = ("project_id", "page_index", "block_id")


def block_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = doc_blocks(spark, sf_dir)
    return x.select(*KEY, "series_label", "source_lang", "reading_order", "manual_status", F.round("confidence", 4).alias("confidence"), F.length("ocr_text").alias("n_text"), F.size("quality_warnings").alias("n_warnings"), F.array_join(F.transform("bbox", lambda v: v.cast("string")), ",").alias("box"))


def project_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects written as JSON documents and read back."""
    path = scratch(spark, "projects")
    sinks.write_projects(doc_blocks(spark, sf_dir), path)
    x = tables.read_project_lines(spark, path)
    return x.select(*KEY, "manual_status", "reading_order", "ocr_text", "translation_fr", F.round("confidence", 4).alias("confidence"), F.size("quality_warnings").alias("n_warnings"))


def review_pack_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 riskiest blocks written as a tab-separated pack and read back as a review table."""
    path = scratch(spark, "pack")
    pack = selection.review_pack(with_quality(doc_blocks(spark, sf_dir)), balanced=False)
    sinks.write_pack(sinks.review_rows(pack), path)
    x = tables.read_review_table(spark, path)
    return x.select(F.col("page_index").cast("int").alias("page_index"), "block_id", F.col("risk_score").cast("int").alias("risk_score"), "review_decision", "source_for_review")


def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page images as manifest rows, one for each page."""
    pages = doc_blocks(spark, sf_dir).select("image_name").distinct()
    x = pages.select(F.regexp_replace("image_name", r"/p(\d+)\.png$", r"/scan__page_$1.png").alias("path"))
    return tables.manifest_from_pages(x)


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sinks.html_pages(doc_blocks(spark, sf_dir))
    return x.select("project_id", "page_index", "html")


def light_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk, action and reasons of every block."""
    x = with_quality(doc_blocks(spark, sf_dir))
    return x.select(*KEY, "risk_score", "suggested_action", "source_tokens", "translation_tokens", F.array_join("risk_reasons", " | ").alias("reasons"))


def review_pack_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: 200 blocks to review, a turn for each series."""
    x = with_quality(doc_blocks(spark, sf_dir)).select(*KEY, "series_label", "risk_score", "suggested_action")
    return selection.review_pack(settled(x, "scored"), limit=200)  # the turns read the scores twice


def risk_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = doc_blocks(spark, sf_dir).withColumn("risk", queue_risk())
    return x.groupBy(band(F.col("risk")).alias("band")).agg(F.count("*").alias("n"), F.sum("risk").alias("total"))


def _filter(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return B.visible(doc_blocks(spark, sf_dir), name).select(*KEY, "manual_status")

    query.__doc__ = f"Visible blocks of the filter {name}."
    return query


filter_warnings, filter_review, filter_untranslated, filter_unvalidated, filter_validated, filter_ignored = (_filter(n) for n in ("warnings", "review", "untranslated", "unvalidated", "validated", "ignored"))


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.visible(doc_blocks(spark, sf_dir), "all", "The ING w1").select(*KEY)


def queue_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.review_queue(doc_blocks(spark, sf_dir)).select(*KEY, "risk", "band", "decision", "label", "source")


def queue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.queue_summary(doc_blocks(spark, sf_dir))


def queue_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each view of the review queue."""
    q = B.review_queue(doc_blocks(spark, sf_dir))
    shown = F.filter(F.array(*(F.when(B.queue_filter(v), F.lit(v)) for v in B.QUEUE_VIEWS)), lambda v: v.isNotNull())
    return q.select("block_id", F.explode(shown).alias("view"))


def zone_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose zone should be read again."""
    return sentence_blocks(spark, sf_dir).where(B.zone_fallback_candidate()).select(*KEY)


def memory_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correction memory written line by line and read back."""
    path = scratch(spark, "memory")
    sinks.write_memory(memory.majority(memory.votes_for_corrections(doc_blocks(spark, sf_dir))), path)
    return tables.read_memory(spark, path, lines=True).select("key", "value")


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = doc_blocks(spark, sf_dir)
    series = F.when(F.expr("seq % 3 = 0"), F.translate("series_label", SMALL, BIG)).otherwise(F.col("series_label"))
    return x.select(F.concat(F.lit("/lib/"), series, F.lit("/v"), (F.col("seq") % 3).cast("string"), F.lit(".cbz")).alias("volume_path"), "page_index")


def duplicate_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders, in any case, with two volumes or more."""
    x = selection.duplicate_parents(_volumes(spark, sf_dir).select("volume_path").distinct())
    return x.select("parent", "volumes", F.array_join("paths", ",").alias("paths"))


def pages_of_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages sampled of each volume, also of those without any."""
    x = _volumes(spark, sf_dir)
    return selection.pages_of_volumes(x.select("volume_path").distinct(), x.where("page_index % 7 = 0").distinct())


def suspect_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkloom.operators.normalise import suspect

    return turn_blocks(spark, sf_dir).where(suspect()).select(*KEY)


def softened_capitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations of documents, a quarter of them in capitals, softened."""
    from inkloom.operators.dialogue import soften_capitals

    return doc_blocks(spark, sf_dir).select(*KEY, soften_capitals(F.col("translation_fr")).alias("soft"))


def prepared_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns made ready for translation, with overrides from the benchmark."""
    from inkloom.operators.dialogue import prepare

    return prepare(turn_blocks(spark, sf_dir), overrides=_bench(spark, sf_dir)).select(*KEY, "corrected", "normalized", "override")


def sfx_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that are a sound alone."""
    return sentence_blocks(spark, sf_dir).where(geometry.sfx_label(F.col("ocr_text"))).select(*KEY)


def refreshable_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = doc_blocks(spark, sf_dir)
    return x.where(B.refreshable("en", True)).select(*KEY, B.protected().alias("protected"), B.learnable().alias("learnable"))


def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.page_stats(doc_blocks(spark, sf_dir))


def project_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.project_stats(doc_blocks(spark, sf_dir))


def renumber_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = doc_blocks(spark, sf_dir).withColumn("reading_order", F.expr("cast(seq % 3 as int)"))
    return B.renumber(x).select(*KEY, "reading_order")


def spatial_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.spatial_order(doc_blocks(spark, sf_dir)).select(*KEY, "reading_order")


def move_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth block of every page moves up."""
    x = doc_blocks(spark, sf_dir)
    moves = x.where("seq % 10 = 3").select(*KEY, F.lit(-1).alias("direction"))
    return B.move(x, moves).select(*KEY, "reading_order")


def edit_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = B.set_field(doc_blocks(spark, sf_dir), "ocr_corrected_text", F.concat(F.lit("  edited "), "block_id"), F.expr("seq % 3 = 0"))
    return x.select(*KEY, "ocr_corrected_text", "raw_translation_fr", F.length("translation_fr").alias("n_fr"), "manual_status", F.size("quality_warnings").alias("n_warnings"))


def set_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = doc_blocks(spark, sf_dir)
    x = B.set_status(x, "review", F.expr("seq % 2 = 0"))
    x = B.set_status(x, "validated", F.expr("seq % 5 = 0"))
    return x.select(*KEY, "manual_status", F.array_join("quality_warnings", "|").alias("warnings"))


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = B.split_lines(doc_blocks(spark, sf_dir))
    return x.select("project_id", "page_index", "block_id", "ocr_text", "reading_order", F.col("bbox")[1].alias("y1"), F.col("bbox")[3].alias("y2"))


def merge_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a page become one block each."""
    x = B.merge_blocks(doc_blocks(spark, sf_dir), F.expr("seq div 2"))
    return x.select(*KEY, "ocr_text", F.round("confidence", 6).alias("confidence"), "n_merged", F.array_join(F.transform("bbox", lambda v: v.cast("string")), ",").alias("box"))


def _review_rows(blocks: DataFrame) -> DataFrame:
    """Review rows made from the row number: every decision occurs, some rows have no block."""
    words = "array('ignore', 'SFX', 'fused', 'zone', 'ok', 'edit', '', 'maybe', 'À revoir', 'merge')"
    return blocks.where("seq % 2 = 0").select(
        "page_index", F.expr("if(seq % 20 = 18, concat('x', block_id), block_id)").alias("block_id"), "seq", F.expr(f"get({words}, cast(seq div 2 % 10 as int))").alias("review_decision"),
        F.expr("if(seq % 3 = 0, concat('ocr ', block_id), '')").alias("corrected_ocr"), F.lit("").alias("corrected_source"), F.expr("if(seq % 7 = 0, 'fr', '')").alias("corrected_fr"), F.expr("if(seq % 4 = 0, 'note', '')").alias("review_notes"),
    )


def apply_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = doc_blocks(spark, sf_dir)
    return B.apply_review(x, _review_rows(x)).select(*KEY, "manual_status", "ocr_corrected_text", "review_notes", "outcome")


def apply_review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = doc_blocks(spark, sf_dir)
    r = _review_rows(x)
    return B.review_counts(B.apply_review(x, r), r)


def auto_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-dialogue sentences and pages."""
    return B.auto_ignore(sentence_blocks(spark, sf_dir)).select(*KEY, "manual_status", "auto_changed", F.array_join("quality_warnings", "|").alias("warnings"))


def page_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_reasons(sentence_blocks(spark, sf_dir)).groupBy("project_id", "page_index").agg(F.max("page_reason").alias("page_reason"), F.count_if(F.col("reason") != "").alias("n_reasons"))


def qc_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of every turn, one row each, in order."""
    from inkloom.functions.checks import apply_checks

    x = apply_checks(turn_blocks(spark, sf_dir).withColumn("manual_status", F.lit("unchecked")).withColumn("source_lang", F.lit("en")))
    return x.select("block_id", F.posexplode("quality_warnings").alias("pos", "warning"))


def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkloom.operators.normalise import normalise

    return normalise(sentence_blocks(spark, sf_dir), colloquial=True).select("block_id", "normalised")


def improved_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with marks put into them, and the clean sentence among the candidates."""
    from inkloom.operators.normalise import improve

    x = sentence_blocks(spark, sf_dir)
    spoilt = x.withColumn("ocr_text", F.when(F.expr("seq % 3 = 0"), F.concat(F.lit("~;|"), "ocr_text")).otherwise(F.col("ocr_text")))
    found = x.select("block_id", F.col("ocr_text").alias("text"), F.lit(0.9).alias("confidence"), F.lit(1).alias("ord"))
    return improve(spoilt, found).select("block_id", "ocr_text", "improved", "manual_status")


def zone_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = text.once(sentence_blocks(spark, sf_dir), _zones=detect.zones(F.col("ocr_text")))
    return x.select(*KEY, F.array_join(detect.categories_of(F.col("_zones")), ",").alias("categories"), F.col("_zones.incomplete").alias("incomplete"))


def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = turn_blocks(spark, sf_dir)
    t = F.col("ocr_text")
    return x.select(*KEY, text.ignore_key(t).alias("ignore_key"), text.memory_key(t).alias("memory_key"), text.replay_key(t).alias("replay_key"), text.identity_key(t).alias("identity_key"), text.path_hash(F.col("block_id")).alias("hash"), text.slug(F.col("series_label")).alias("slug"))


def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages ranked by the natural order of their URLs."""
    p = table(spark, sf_dir, "pages").where("url is not null").withColumn("key", text.natural_key(F.col("url")))
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    x = tables.ranked(p.select("page_id", "url", "key", host.alias("host")), ["host", "key", "url", "page_id"])  # a host of any size is many parts
    first = x.groupBy("host").agg(F.min("index").alias("first"))
    return x.join(first, "host").select("page_id", "host", (F.col("index") - F.col("first") + 1).cast("int").alias("rank"))


def stratified_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.stratified_limit(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 150)


def random_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select_rows(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "random", 100, start=10)


def volume_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = doc_blocks(spark, sf_dir).select("series_label", F.concat(F.lit("v"), (F.col("seq") % 12).cast("string")).alias("volume")).distinct()
    return selection.volume_ordinals(x.withColumn("natural", text.natural_key(F.col("volume")))).select("series_label", "volume", "series_index", "series_volume_number", "series_volume_count")


def chosen_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First volumes of each series."""
    x = doc_blocks(spark, sf_dir).select("series_label", F.concat(F.lit("v"), (F.col("seq") % 12).cast("string")).alias("volume")).distinct()
    return selection.choose_volumes(x.withColumn("natural", text.natural_key(F.col("volume"))), 2, mode="first").select("series_label", "volume")


def sampled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten pages of each series, mixed mode."""
    x = doc_blocks(spark, sf_dir).select(F.col("series_label").alias("volume_label"), "page_index").distinct()
    return selection.choose_pages(x, 10).select("volume_label", "page_index")


def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest document of each first word, the first on ties."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.regexp_extract("text", r"^[A-Za-z]+", 0)).alias("word"), F.length("text").alias("score"))
    return selection.best_candidate(x, ["word"], "score", "doc_id")


def repeated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = learning.repeated_sources(with_texts(doc_blocks(spark, sf_dir)))
    return x.select("source", "count", F.array_join("translations", "|").alias("translations"))


def suspicious_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.suspicious_tokens(with_quality(doc_blocks(spark, sf_dir)))


def name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.name_candidates(with_texts(doc_blocks(spark, sf_dir)))


def residue_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.residue_tokens(with_texts(turn_blocks(spark, sf_dir)))


def token_risk_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.token_risk(with_quality(doc_blocks(spark, sf_dir))).select("token", "count", "high_risk_count", "risk_weight")


def glossary_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.glossary_candidates(doc_blocks(spark, sf_dir)).select("term", "count")


def translation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.translation_counts(doc_blocks(spark, sf_dir)).select("source_lang", "source", "translation_fr", "count")


def correction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.correction_counts(doc_blocks(spark, sf_dir)).select("ocr_raw", "ocr_corrected", "count")


def riskiest_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.riskiest(doc_blocks(spark, sf_dir)).select(*KEY, "risk_score")


def learning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.learning_summary(doc_blocks(spark, sf_dir))


def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.profile_summary(with_quality(doc_blocks(spark, sf_dir)))


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.quality_report(doc_blocks(spark, sf_dir))


def majority_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority votes over first words as keys and languages as values."""
    return memory.majority(_votes(spark, sf_dir))


def memory_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.conflicts(_votes(spark, sf_dir))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.lower(F.regexp_extract("text", r"^[A-Za-z]+", 0)).alias("key"), F.col("lang").alias("value"), F.col("doc_id").alias("seq")).where("key <> ''")


def translation_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.majority(memory.votes_for_translations(doc_blocks(spark, sf_dir)))


def ocr_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.majority(memory.votes_for_corrections(doc_blocks(spark, sf_dir)))


def ignore_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.majority(memory.votes_for_ignoring(doc_blocks(spark, sf_dir)))


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(text.memory_key(F.col("text")).alias("key"), F.col("item_id").cast("string").alias("value"), F.col("item_id").alias("seq")).groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return d.unionByName(table(spark, sf_dir, "benchmark").select((-F.col("item_id") - 1).alias("doc_id"), F.lit(0).alias("line"), F.concat(F.lit("  "), "text", F.lit(" ...")).alias("text")))


def memory_lookup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, and benchmark items with blanks and dots around them, looked up in the benchmark."""
    return memory.lookup(_lines(spark, sf_dir), _bench(spark, sf_dir), text.memory_key(F.col("text"))).where("found is not null").select("doc_id", "line", "found")


def memory_lookup_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with a word left out, found in the benchmark by similarity."""
    b = table(spark, sf_dir, "benchmark").select(text.memory_key(F.regexp_replace("text", r"^(\S+ \S+) \S+", "$1")).alias("key"))
    return memory.fuzzy(b, _bench(spark, sf_dir)).select("key", "memory_key", "value", F.round("ratio", 6).alias("ratio"))


def glossary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.regexp_extract("text", r"^[A-Za-z]+", 0).alias("source"), F.col("doc_id").alias("pos")).where("source <> ''").groupBy("source").agg(F.min("pos").alias("pos"))
    words = words.groupBy(F.lower("source").alias("source")).agg(F.min("pos").alias("pos"))
    own = words.where("pos % 3 = 0").select(F.upper("source").alias("source"), F.lit("x").alias("target"), "pos")
    return memory.glossary(words.select("source", F.col("source").alias("target"), "pos"), own).select("source", "target", "first_list", "pos")


def benchmark_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words that follow each other in a benchmark text are a term, and so is every word of nine letters or more."""
    x = table(spark, sf_dir, "benchmark").select(F.split(F.btrim("text"), r"\s+").alias("w"))
    two = F.transform(F.sequence(F.lit(2), F.size("w")), lambda i: F.concat_ws(" ", F.get("w", i - 2), F.get("w", i - 1)))
    pairs = x.where("size(w) > 1").select(F.explode(two).alias("source"))
    words = x.select(F.explode("w").alias("source")).where(F.length("source") >= 9)
    return pairs.unionByName(words).select(F.lower("source").alias("source")).where("source <> ''").distinct().withColumn("target", F.concat(F.lit("<"), "source", F.lit(">"))).withColumn("pos", F.col("source"))


def protected_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of the benchmark hidden in conversations and put back."""
    from inkloom.operators.terms import protect_terms

    x = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return protect_terms(x, benchmark_terms(spark, sf_dir)).select("conv_id", "turn", "protected", "restored", F.size("used").alias("n_terms"))


def cut_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; in some, words of eight ASCII letters or more are cut after four, as at a line's end."""
    x = table(spark, sf_dir, "documents").select("doc_id", "text")
    return x.withColumn("ocr_text", F.when(F.col("doc_id") % 7 == 0, F.regexp_replace("text", r"([A-Za-z]{4})([A-Za-z]{4,})", "$1- $2")).otherwise(F.col("text")))


def hyphen_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether halves of words that documents cut belong together, by the other documents."""
    from inkloom.operators.hyphens import hyphen_lexicon

    return hyphen_lexicon(cut_documents(spark, sf_dir))


def mended_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkloom.operators.hyphens import hyphen_lexicon, mend_hyphens

    x = cut_documents(spark, sf_dir)
    return mend_hyphens(x, hyphen_lexicon(x)).select("doc_id", F.sha2("mended", 256).alias("mended_sha256"), (F.col("mended") == F.col("text")).alias("restored"))


def _found(blocks: DataFrame) -> DataFrame:
    """A second run: boxes moved by an amount that depends on the row, every eighth one lost, some texts changed."""
    d = F.expr("cast(seq % 5 * 9 as int)")
    box = F.array(F.col("bbox")[0] + d, F.col("bbox")[1] + d, F.col("bbox")[2] + d, F.col("bbox")[3] + d)
    return blocks.where("seq % 8 <> 7").withColumn("bbox", box).withColumn("block_id", F.concat(F.lit("n"), "block_id")).withColumn("ocr_text", F.when(F.expr("seq % 6 = 0"), F.reverse("ocr_text")).otherwise(F.col("ocr_text")))


def iou_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = doc_blocks(spark, sf_dir)
    return geometry.best_match(x, _found(x)).select("page_index", "target_id", "matched_id", F.round("bbox_iou", 6).alias("bbox_iou"))


def replay_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed turns against a second run."""
    x = turn_blocks(spark, sf_dir)
    return evaluate.replay(x.where("manual_status in ('validated', 'edited')"), _found(x)).select(*PAGE_TARGET, "status", "source_evaluation")


PAGE_TARGET = ("project_id", "page_index", "target_id", "matched_id")


def replay_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = turn_blocks(spark, sf_dir)
    return evaluate.replay_totals(evaluate.replay(x.where("manual_status in ('validated', 'edited')"), _found(x)))


def rescued_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = doc_blocks(spark, sf_dir)
    return geometry.supplement(x.where("seq % 2 = 0"), _found(x)).select("project_id", "page_index", "block_id", "seq")


def line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.group_lines(doc_blocks(spark, sf_dir)).select("project_id", "page_index", "block_id", "ocr_text", "reading_order", "n_lines")


def diagnose_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.diagnose_counts(evaluate.diagnose(turn_blocks(spark, sf_dir)))


def diagnose_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.examples(evaluate.diagnose(turn_blocks(spark, sf_dir))).select("category", "rn", "block_id", "reason")


def similarity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.similarity_scores(turn_blocks(spark, sf_dir))


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as recognised fragments, in a column of lines on each page."""
    x = sentence_blocks(spark, sf_dir)
    y = F.col("reading_order") * 30.0
    polygon = F.array(*(F.array(F.lit(a), y + b) for a, b in ((10.0, 0.0), (210.0, 0.0), (210.0, 24.0), (10.0, 24.0))))
    return x.select("project_id", "page_index", F.col("reading_order").alias("raw_order"), polygon.alias("polygon"), F.col("ocr_text").alias("text"), (F.lit(1.0) - F.expr("seq % 100") / 100).alias("confidence"), F.lit("en").alias("source_lang"))


def _stand_in(batches):
    """A translator for tests: words in reverse order."""
    for p in batches:
        yield p.assign(translation=p["text"].map(lambda t: " ".join(reversed(t.split()))))


def processed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments to checked blocks with a stand-in translator."""
    from inkloom.plans.pipeline import process

    x = process(_fragments(spark, sf_dir), _stand_in)
    return x.select(*KEY, "manual_status", F.length("translation_fr").alias("n_fr"), F.size("quality_warnings").alias("n_warnings"))


def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkloom.plans.pipeline import corpus_totals as totals

    return totals(doc_blocks(spark, sf_dir))


def fragment_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments that are no text."""
    x = _fragments(spark, sf_dir)
    return x.where(geometry.noise(F.col("text"), F.col("confidence"))).select("page_index", "raw_order")


def refreshed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkloom.plans.pipeline import refresh

    x = refresh(sentence_blocks(spark, sf_dir), "en", _stand_in, include_review=True)
    return x.select(*KEY, "manual_status", F.length("translation_fr").alias("n_fr"))


def resumed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages still to be processed after a first run that took the even ones."""
    from inkloom.streaming.resume import pending

    pages = doc_blocks(spark, sf_dir).select("project_id", "page_index").distinct()
    return pending(pages, pages.where("page_index % 2 = 0"))


def queries() -> dict:
    own = {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}
    for k in ("queries", "benchmark_terms", "cut_documents"):
        own.pop(k)
    return own
