"""One registered query per operator or job, over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import unnest
from ..functions.labels import CONTAINS_BUG, NO_BUG
from ..functions.masking import KINDED, PLAIN, mask, unmask
from ..functions.paths import is_system_verilog, output_folder, suffix
from ..functions.prompts import detection_prompt, log_sizes, record_key, rename_prompt
from ..functions.text import (
    code_blocks,
    collapse_whitespace,
    first_json_object,
    identifier_tokens,
    is_identifier,
    json_entries,
    normalized_lines,
)
from ..functions.words import RESERVED, is_candidate
from ..operators import chunking, diffs, equivalence, evaluation, renaming, scoring, snapshots
from ..plans.analyze import OUTPUTS, analyze, analyze_file
from ..plans.collect import collect_responses
from ..plans.pair_corpus import build_pair_corpus
from ..plans.rename_corpus import apply_rename_responses, rename_corpus, rename_summary
from ..plans.score import pairs_from_emitted
from ..plans.shuffle_corpus import shuffle_corpus, write_shuffled
from ..schemas import RESPONSES
from ..sizing import widened
from ..sources.corpus import export_tree, exported_manifest, scan_corpus
from ..sources.log import append_log, read_log
from ..sources.scratch import fresh_dir
from ..sources.tables import current_version, read_table, write_csv, write_three_ways
from . import views
from .views import RENAME_JSON, VIEWS

SEED = 7

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """A driver table; with keys, its scan is spread by them if the session asks for that."""
    df = read_table(spark, f"{sf_dir}/{name}.parquet")
    return widened(df, *keys) if keys else df


def view(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """A derived view; ``keys`` as for :func:`table`, applied to the driver table below it."""
    sql, needed = VIEWS[name]
    inputs = {
        n: view(spark, sf_dir, n, *keys) if n in VIEWS else table(spark, sf_dir, n, *keys) for n in needed
    }
    return spark.sql(sql, **inputs)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id")


# --- evaluation -------------------------------------------------------------------------------


def labels_rowlevel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analyze(view(spark, sf_dir, "reviews")).rows
    return rows.select(
        "uuid", "input_file_rel_path", "challenge_id", evaluation.EXPECTED, evaluation.ACTUAL
    )


def labels_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict label domain over responses that all lie within it."""
    strict = evaluation.with_labels(view(spark, sf_dir, "usable_reviews"), strict=True)
    return strict.select("uuid", evaluation.EXPECTED, evaluation.ACTUAL)


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(view(spark, sf_dir, "reviews")).confusion_matrix


def by_challenge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(view(spark, sf_dir, "reviews")).results_by_challenge


def by_model_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = evaluation.with_labels(view(spark, sf_dir, "reviews"))
    return evaluation.confusion_matrix(labelled, "llm_model_name")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = evaluation.with_labels(view(spark, sf_dir, "reviews"))
    usable = F.col(evaluation.ACTUAL).isin(CONTAINS_BUG, NO_BUG)
    status = F.when(usable, "processed").otherwise("skipped")
    return evaluation.status_counts(labelled.select(status.alias("status")))


# --- text functions ---------------------------------------------------------------------------


def normalize_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", collapse_whitespace(F.col("text")).alias("text"))


def normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = unnest(
        documents(spark, sf_dir), normalized_lines(F.col("text")), "doc_id", item="line", pos="line_no"
    )
    return lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


def code_block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = view(spark, sf_dir, "reviews", "doc_id")
    blocks = unnest(reviews, code_blocks(F.col("llm_response")), "uuid", item="block", pos="block_no")
    return blocks.select("uuid", F.col("block_no").cast("bigint").alias("block_no"), "block")


def json_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.concat(F.lit("note: "), F.col("props"), F.lit(" end {"))
    return table(spark, sf_dir, "events", "event_id").select(
        "event_id", first_json_object(note).alias("object")
    )


def json_entry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "event_id")
    entries = unnest(events, json_entries(F.col("props")), "event_id", item="e")
    return entries.select("event_id", "e.key", "e.value", "e.is_text")


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    bare = F.regexp_replace(url, "[?#].*", "")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        suffix(url).alias("suffix"),
        suffix(bare).alias("bare_suffix"),
        output_folder(F.lit("site"), url).alias("folder"),
        is_system_verilog(F.concat(bare, F.when(F.col("page_id") % 2 == 0, ".SV").otherwise(".v"))).alias("is_sv"),
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    v2 = detection_prompt(text)
    return documents(spark, sf_dir).select(
        "doc_id",
        F.md5(detection_prompt(text, "v1")).alias("v1_md5"),
        F.md5(v2).alias("v2_md5"),
        F.md5(rename_prompt(text)).alias("rename_md5"),
        record_key(F.col("source"), v2, F.lit("model-a")).alias("uuid"),
        *log_sizes(v2, text),
    )


def rename_prompt_dedent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The renaming prompt over texts whose indentation varies."""
    pad = F.expr("repeat(' ', cast(doc_id % 7 as int))")
    text = F.concat(F.lit("top\n"), pad, F.replace("text", F.lit("\n"), F.concat(F.lit("\n"), pad)), F.lit("\n   "))
    return documents(spark, sf_dir).select("doc_id", F.md5(rename_prompt(text)).alias("prompt_md5"))


def valid_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = unnest(documents(spark, sf_dir), F.split("text", "[ \n]+"), item="name").drop("pos")
    name = F.col("name")
    return (
        words.groupBy("name")
        .agg(F.count("*").alias("n"))
        .select("name", "n", is_identifier(name).alias("is_identifier"), is_candidate(name).alias("is_candidate"))
    )


def candidate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.array_distinct(identifier_tokens(F.col("text")))
    names = unnest(documents(spark, sf_dir), tokens, item="name").select("name").distinct()
    words = spark.createDataFrame([(word,) for word in RESERVED], "name string")
    return renaming.exclude_words(names, words)


# --- masking ----------------------------------------------------------------------------------


def mask_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id").select("page_id", "html")
    style_rows = []
    for name, style in (("kinded", KINDED), ("plain", PLAIN)):
        masked = pages.withColumn("m", mask(F.col("html"), style))
        style_rows.append(
            masked.select(
                "page_id",
                F.lit(name).alias("style"),
                F.size("m.hits").cast("bigint").alias("n_hits"),
                F.md5("m.masked").alias("masked_md5"),
                (unmask(F.col("m.masked"), F.col("m.hits"), style) == F.col("html")).alias("round_trip"),
            )
        )
    return style_rows[0].unionByName(style_rows[1])


def mask_based_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masking that steps over based literals; here only the count and the round trip are reported."""
    code = F.concat(F.lit("q <= 2'b00; r = 8'hFF; "), F.col("text"))
    masked = view(spark, sf_dir, "rtl_docs", "doc_id").select("doc_id", code.alias("code")).withColumn(
        "m", mask(F.col("code"), PLAIN, keep_based_literals=True)
    )
    return masked.select(
        "doc_id",
        F.size("m.hits").cast("bigint").alias("n_hits"),
        F.col("m.masked").alias("masked"),
        (unmask(F.col("m.masked"), F.col("m.hits"), PLAIN) == F.col("code")).alias("round_trip"),
    )


# --- renaming ---------------------------------------------------------------------------------


def _renamed_by_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rename_responses(view(spark, sf_dir, "answers", "doc_id"), text="text")


def mapping_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renaming.judge_mapping_table(
        view(spark, sf_dir, "mappings"), documents(spark, sf_dir).select("doc_id", "text")
    ).select("doc_id", F.col("ord").cast("bigint").alias("ord"), "old_name", "new_name", "reason")


def mapping_accept_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = unnest(_renamed_by_response(spark, sf_dir), F.col("verdicts"), "doc_id", item="v")
    return verdicts.select(
        "doc_id", F.col("v.ord").cast("bigint").alias("ord"), "v.old_name", "v.new_name", "v.reason"
    )


def mapping_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renaming.reason_counts(mapping_accept(spark, sf_dir))


def rename_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _renamed_by_response(spark, sf_dir).select("doc_id", F.col("renamed").alias("text"))


def rename_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = documents(spark, sf_dir).select("doc_id", "text")
    return renaming.rename_by_proposals(texts, view(spark, sf_dir, "mappings"))


def long_mappings(docs: DataFrame) -> DataFrame:
    """The view of that name. It takes words of a text by their place, each by a split of the text, and none
    beyond its first 40; so a text's start up to there is cut out once and is all that is split."""
    sql, _ = VIEWS["long_mappings"]
    starts = docs.select("doc_id", F.substring_index("text", " ", max(views.OWN_WORDS, views.OTHER_WORDS)).alias("text"))
    return docs.sparkSession.sql(sql, documents=starts)


def rename_join_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings of far more pairs than their documents name; one has a third of all pairs."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return renaming.rename_by_proposals(docs, long_mappings(docs))


def rename_corpus_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = f"Sure: {RENAME_JSON} done"

    def responder(prompt: str) -> str:
        return answer if "the" in prompt.rsplit("--- BEGIN CODE ---", 1)[1] else "no idea"

    corpus = documents(spark, sf_dir).select("doc_id", "text")
    return rename_corpus(corpus, responder, text="text", concurrency=1).select(
        "doc_id", "status", F.md5("renamed").alias("renamed_md5")
    )


def rename_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rename_summary(_renamed_by_response(spark, sf_dir))


# --- chunks and reordering --------------------------------------------------------------------


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.module_table(view(spark, sf_dir, "rtl_docs", "doc_id"))
    return rows.withColumn("module_no", F.col("module_no").cast("bigint"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.chunk_table(view(spark, sf_dir, "rtl_docs", "doc_id"))
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("module_no", "chunk_no")})


def _placement(level: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        placed = chunking.placement_table(view(spark, sf_dir, "rtl_docs", "doc_id"), seed=SEED, level=level)
        return placed.select(
            "doc_id",
            F.col("module_no").cast("bigint").alias("module_no"),
            F.col("slot").cast("bigint").alias("slot"),
            "bucket",
            F.col("chunk_no").cast("bigint").alias("chunk_no"),
            "kind",
            "chunk_id",
        )

    return query


def _shuffled(level: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        shuffled = chunking.shuffle_documents(
            view(spark, sf_dir, "rtl_docs", "doc_id"), seed=SEED, level=level
        )
        return shuffled.select("doc_id", "text", "order_json")

    return query


# --- sources and sinks: each writes to a fresh folder that the cluster shares and reads it back -------------


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents through CSV files whose fields span lines."""
    source = table(spark, sf_dir, "documents")
    path = f"{fresh_dir(spark, 'csv')}/documents.csv"
    write_csv(source, path)
    return read_table(spark, path, source.schema)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "reviews").select(
        "uuid",
        "input_file_rel_path",
        "input_file_contents",
        F.md5("input_file_contents").alias("llm_prompt"),
        "llm_response",
        "llm_model_name",
    )


def response_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that two overlapping runs add to, the second one with every record twice."""
    records, path = _records(spark, sf_dir), f"{fresh_dir(spark, 'log')}/responses.ndjson"
    append_log(records.where("llm_model_name <> 'model-1'"), path)
    append_log(records.unionByName(records), path)
    return read_log(spark, path, RESPONSES)


def _source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content`` of a tree: some folders and files hidden, some files empty or not UTF-8."""
    own, body = F.col("doc_id"), F.col("text").cast("binary")
    name = F.concat(
        F.lit("ch"),
        (own % 50).cast("string"),
        F.when(own % 29 == 0, "/.deep/").otherwise("/"),
        F.when(own % 31 == 0, "_").when(own % 37 == 0, ".").otherwise(""),
        F.lit("f"),
        own.cast("string"),
        F.when(own % 2 == 0, ".sv").otherwise(".v"),
    )
    content = F.when(own % 43 == 7, F.lit(b"")).when(own % 41 == 5, F.concat(body, F.lit(b"\xff("))).otherwise(body)
    return documents(spark, sf_dir).select(name.alias("path"), content.alias("content"))


def corpus_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a tree of source files, some hidden, empty or not UTF-8, and the scan of that tree."""
    root = fresh_dir(spark, "tree")
    export_tree(_source_files(spark, sf_dir), root, path="path", content="content")
    return scan_corpus(spark, root).select(
        "path", "valid_utf8", F.when(F.col("valid_utf8"), F.md5("content")).alias("content_md5")
    )


def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export of that tree says it has written."""
    root = fresh_dir(spark, "tree")
    export_tree(_source_files(spark, sf_dir), root, path="path", content="content")
    return exported_manifest(spark, root)


def analysis_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three tables of an analysis job, as written, one after the other."""
    path = f"{fresh_dir(spark, 'analysis')}/responses.pq"
    _records(spark, sf_dir).write.parquet(path)
    out = analyze_file(spark, path)
    rows, matrix, challenges = (spark.read.parquet(f"{out}/{name}") for name in OUTPUTS)
    label = F.concat_ws("/", "expected_detection_result", "actual_detection_result")
    def cents(share: str) -> Column:
        return F.round(F.col(share) * 100).cast("bigint").cast("string")

    shares = [cents(c) for c in ("correct_overall_pct", "correctly_detected_bug_pct")]
    return (
        rows.select(F.lit("rows").alias("output"), F.col("uuid").alias("name"), label.alias("value"), F.lit(1).cast("long").alias("count"))
        .unionByName(matrix.select(F.lit("matrix").alias("output"), label.alias("name"), cents("percent").alias("value"), "count"))
        .unionByName(
            challenges.select(
                F.lit("challenges").alias("output"),
                F.col("challenge_id").alias("name"),
                F.concat_ws("/", *shares).alias("value"),
                F.col("total_llm_prompts").alias("count"),
            )
        )
    )


def three_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table in three formats, written twice; the current version of each is read back."""
    source = view(spark, sf_dir, "branches")
    root = fresh_dir(spark, "formats")
    write_three_ways(source.limit(0), root)
    write_three_ways(source, root)
    where = current_version(spark, root)
    parts = [
        read_table(spark, f"{where}/all_metadata.{kind}", source.schema).withColumn("format", F.lit(kind))
        for kind in ("pq", "ndjson", "csv")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def shuffle_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reordered texts and their side file of maps as a job leaves them."""
    shuffled = shuffle_corpus(view(spark, sf_dir, "rtl_docs", "doc_id"), text="text", seed=SEED)
    root = fresh_dir(spark, "shuffled")
    write_shuffled(shuffled, root, key="doc_id")
    where = current_version(spark, root)
    maps = spark.read.schema("doc_id long, order_json string").json(f"{where}/order_maps.ndjson")
    texts = spark.read.parquet(f"{where}/texts.pq").select("doc_id", F.md5("text").alias("text_md5"))
    return texts.join(maps, "doc_id").select("doc_id", "text_md5", F.md5("order_json").alias("order_md5"))


# --- diffs and scores -------------------------------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "code_pairs", "doc_id")


def diff_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.chunk_table(_pairs(spark, sf_dir))


def diff_chunks_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.chunk_table(_pairs(spark, sf_dir), mode=diffs.EXACT)


def diff_opcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.opcode_table(_pairs(spark, sf_dir))


def similarity_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.similarity_table(
        view(spark, sf_dir, "reports"), view(spark, sf_dir, "code_pairs")
    )


def report_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.report_scores(view(spark, sf_dir, "reports"), view(spark, sf_dir, "code_pairs"))


def report_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports joined to their pair, with the number of blocks each one offers."""
    blocks = scoring.report_blocks(view(spark, sf_dir, "reports"), keys=["report_id", "pair_id"])
    pairs = view(spark, sf_dir, "code_pairs").select("pair_id")
    return blocks.join(pairs, "pair_id").select(
        "report_id",
        "pair_id",
        F.size("blocks").cast("bigint").alias("n_blocks"),
        F.array_join("blocks", "|").alias("blocks"),
    )


# --- snapshots --------------------------------------------------------------------------------


def override_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "override_paths")


def _pair_corpus(spark: SparkSession, sf_dir: str):
    return build_pair_corpus(
        view(spark, sf_dir, "snapshots"), view(spark, sf_dir, "branches"), override_table(spark, sf_dir)
    )


def branch_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.branch_names(view(spark, sf_dir, "refs"))


def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.changed_paths(view(spark, sf_dir, "snapshots"))


def branch_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_corpus(spark, sf_dir).selected


def branch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_corpus(spark, sf_dir).counts


def pair_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_corpus(spark, sf_dir).files


def emitted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pairs_from_emitted(_pair_corpus(spark, sf_dir).files)
    return pairs.select("challenge_id", F.md5("base_code").alias("base_md5"), F.md5("buggy_code").alias("buggy_md5"))


def metadata_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata = _pair_corpus(spark, sf_dir).metadata
    repos = [metadata.where(F.col("git_repo").endswith(end)) for end in ("repo0", "repo1")]
    return snapshots.union_metadata(*repos)


# --- equivalence ------------------------------------------------------------------------------


def dataset_equiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    changed = gold.withColumn(
        "text", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    )
    cases = {
        "identical": equivalence.dataset_equivalence(gold, gold.select("lang", "text", "doc_id")),
        "changed": equivalence.dataset_equivalence(gold, changed),
        "fewer": equivalence.dataset_equivalence(gold, gold.where(F.col("lang") != "en")),
        "repeated": equivalence.dataset_equivalence(gold, gold.unionAll(gold)),
        "missing": equivalence.dataset_equivalence(gold, None),
    }
    combined = None
    for name, result in cases.items():
        row = result.select(F.lit(name).alias("case"), F.col("verdict").cast("bigint").alias("verdict"), "only_gold", "only_gate")
        combined = row if combined is None else combined.unionByName(row)
    return combined


def rename_equiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renamed texts with a tail of code: as it is, or with a literal, comment, keyword or string changed."""
    kind = F.col("doc_id") % 6
    tail = F.lit(views.CODE_TAIL)
    for n, (old, new) in enumerate(views.TAIL_EDITS):
        tail = F.when(kind == n, F.lit(views.CODE_TAIL.replace(old, new))).otherwise(tail)
    pairs = _renamed_by_response(spark, sf_dir).select(
        "doc_id", F.concat("text", F.lit(views.CODE_TAIL)).alias("gold"), F.concat("renamed", tail).alias("gate")
    )
    return equivalence.rename_verdicts(pairs, key="doc_id").withColumn("verdict", F.col("verdict").cast("bigint"))


# --- collection -------------------------------------------------------------------------------


def collect_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    def responder(prompt: str) -> str:
        body = prompt.split("```systemverilog\n", 1)[1]
        if body.startswith("The"):
            raise ValueError("refused")
        return f"  {len(prompt)} characters\n"

    corpus = documents(spark, sf_dir).select(
        F.concat(F.lit("ch"), F.col("doc_id") % 50, F.lit("/f"), F.col("doc_id"), F.lit(".sv")).alias("path"),
        F.col("text").alias("content"),
    )
    collected = collect_responses(corpus, responder, model="model-a")
    return collected.select(
        "uuid",
        "input_file_rel_path",
        F.md5("input_file_contents").alias("contents_md5"),
        F.md5("llm_prompt").alias("prompt_md5"),
        "llm_response",
        "llm_model_name",
        "error",
    )


QUERIES: dict[str, Query] = {
    "labels_rowlevel": labels_rowlevel,
    "labels_strict": labels_strict,
    "confusion_matrix": confusion_matrix,
    "by_challenge": by_challenge,
    "by_model_confusion": by_model_confusion,
    "run_summary": run_summary,
    "normalize_ws": normalize_ws,
    "normalize_lines": normalize_lines,
    "code_blocks": code_block_rows,
    "json_from_text": json_from_text,
    "json_entries": json_entry_rows,
    "path_parts": path_parts,
    "prompts": prompts,
    "rename_prompt_dedent": rename_prompt_dedent,
    "valid_identifiers": valid_identifiers,
    "candidate_names": candidate_names,
    "mask_roundtrip": mask_roundtrip,
    "mask_based_literals": mask_based_literals,
    "mapping_accept": mapping_accept,
    "mapping_accept_inline": mapping_accept_inline,
    "mapping_reasons": mapping_reasons,
    "rename_tokens": rename_tokens,
    "rename_join": rename_join,
    "rename_join_long": rename_join_long,
    "rename_corpus": rename_corpus_stub,
    "rename_run_summary": rename_run_summary,
    "modules": modules,
    "chunks": chunks,
    "shuffle_groups": _placement("safe"),
    "shuffle_groups_medium": _placement("medium"),
    "shuffle_groups_aggressive": _placement("aggressive"),
    "shuffle_corpus": _shuffled("safe"),
    "shuffle_corpus_medium": _shuffled("medium"),
    "shuffle_corpus_aggressive": _shuffled("aggressive"),
    "csv_round_trip": csv_round_trip,
    "response_log": response_log,
    "corpus_round_trip": corpus_round_trip,
    "export_manifest": export_manifest,
    "analysis_outputs": analysis_outputs,
    "three_formats": three_formats,
    "shuffle_outputs": shuffle_outputs,
    "diff_chunks": diff_chunks,
    "diff_chunks_exact": diff_chunks_exact,
    "diff_opcodes": diff_opcodes,
    "similarity_best": similarity_best,
    "report_scores": report_scores,
    "report_blocks": report_blocks,
    "branch_names": branch_names,
    "changed_paths": changed_paths,
    "branch_select": branch_select,
    "branch_counts": branch_counts,
    "pair_emit": pair_emit,
    "emitted_pairs": emitted_pairs,
    "metadata_union": metadata_union,
    "dataset_equiv": dataset_equiv,
    "rename_equiv": rename_equiv,
    "collect_stub": collect_stub,
}
