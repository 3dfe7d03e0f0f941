"""Module blocks, their code chunks, and seeded reordering of chunks.

Everything about one source text happens on its own row with array functions, so reordering a corpus
needs no shuffle and no group is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind, unnest
from ..functions.masking import PLAIN, mask, unmask
from ..functions.text import WHITESPACE

# Block and chunk patterns in order of precedence, kinds never moved, the buckets of
# the medium level and the single bucket of the aggressive one. W stands for a word character and S
# for whitespace as Python's str patterns see them.
_W = r"[\p{L}\p{N}_]"
_S = WHITESPACE
MODULE_PATTERN = (
    rf"(?isU:(?=[mip\x{{131}}])\b(module|interface|program|package)\b{_S}+([A-Za-z_]{_W}*)\b(.*?)"
    r"(?=e)(\bendmodule\b|\bendinterface\b|\bendprogram\b|\bendpackage\b))"
)
CHUNK_PATTERNS = (
    ("generate", r"(?isU:\bgenerate\b.*?\bendgenerate\b)"),
    ("param", r"(?isU:\b(?:parameter|localparam)\b[^;]*?;)"),
    ("typedef", r"(?isU:\b(?:typedef)\b.*?;)"),
    ("decl", r"(?isU:\b(?:wire|reg|logic|bit|byte|int|shortint|longint)\b[^;]*?;)"),
    ("assign", r"(?isU:\bassign\b[^;]*?;)"),
    ("always", r"(?isU:\b(?:always|initial)\b\b.*?(?:end\b|;))"),
    ("func", r"(?isU:\b(?:function|task)\b.*?\bend(?:function|task)\b)"),
    ("inst", rf"(?mdU:^[ \t]*[A-Za-z_]{_W}*[ \t]+{_W}+[ \t]*\([^;{{)]*?\){_S}*;)"),
)
PINNED = "pinned"
PINNED_KINDS = ("generate",)
MEDIUM_BUCKETS = (
    ("types_params_decls", ("param", "typedef", "decl")),
    ("assigns", ("assign",)),
    ("procedural", ("always", "func", "inst")),
)
AGGRESSIVE_BUCKET = "aggressive_all"
LEVELS = ("safe", "medium", "aggressive")

# All but the last pattern start with a keyword; a word start and its first letter rule out most
# places before the alternatives are tried one by one.
_KEYWORD_CHUNK = "|".join(pattern for _, pattern in CHUNK_PATTERNS[:-1])
_ANY_CHUNK = rf"(?U:\b)(?=(?iu:[abfgilprstw]))(?:{_KEYWORD_CHUNK})|{CHUNK_PATTERNS[-1][1]}"


def module_texts(text: Column) -> Column:
    """Module-like blocks of a (masked) text, in order."""
    return F.regexp_extract_all(text, F.lit(MODULE_PATTERN), 0)


def module_gaps(text: Column) -> Column:
    """Text before, between and after the blocks; one more than there are blocks."""
    return F.split(text, MODULE_PATTERN, -1)


def module_name(block: Column) -> Column:
    """Name in a block's header."""
    return F.regexp_extract(block, MODULE_PATTERN, 2)


def chunk_kind(chunk: Column) -> Column:
    """Kind of a matched stretch: the first pattern that matches at its start."""
    kind = F.lit(CHUNK_PATTERNS[-1][0])
    for name, pattern in reversed(CHUNK_PATTERNS[:-1]):
        kind = F.when(chunk.rlike(r"\A" + pattern), name).otherwise(kind)
    return kind


def split_chunks(block: Column) -> Column:
    """Chunks of one block: ``array<struct<chunk_no,kind,text,pinned,chunk_id>>``.

    The leftmost match wins and, at one place, the earlier pattern, which is what an ordered regex
    alternation does. Text between matches is pinned, so the chunks always add up to the block.
    """

    def pieces(gaps: Column, hits: Column) -> Column:
        return F.filter(
            F.flatten(
                F.transform(
                    gaps,
                    lambda gap, i: F.array(
                        F.struct(F.lit(PINNED).alias("kind"), gap.alias("text")),
                        F.struct(
                            chunk_kind(F.get(hits, i)).alias("kind"),
                            F.coalesce(F.get(hits, i), F.lit("")).alias("text"),
                        ),
                    ),
                )
            ),
            lambda p: p["text"] != "",
        )

    def numbered(p: Column, i: Column) -> Column:
        number = i.cast("int")
        return F.struct(
            number.alias("chunk_no"),
            p["kind"].alias("kind"),
            p["text"].alias("text"),
            p["kind"].isin(PINNED, *PINNED_KINDS).alias("pinned"),
            F.format_string("%s_%06d", F.upper(p["kind"]), number).alias("chunk_id"),
        )

    return bind(
        F.regexp_extract_all(block, F.lit(_ANY_CHUNK), 0),
        lambda hits: F.transform(pieces(F.split(block, _ANY_CHUNK, -1), hits), numbered),
    )


def bucket(kind: Column, pinned: Column, level: str) -> Column:
    """Group within which a chunk may move; NULL for chunks that stay."""
    if level == "safe":
        group = kind
    elif level == "medium":
        group = F.lit(None).cast("string")
        for name, kinds in reversed(MEDIUM_BUCKETS):
            group = F.when(kind.isin(*kinds), name).otherwise(group)
    elif level == "aggressive":
        group = F.lit(AGGRESSIVE_BUCKET)
    else:
        raise ValueError(f"unknown level: {level}; expected one of {', '.join(LEVELS)}")
    return F.when(~pinned, group)


def reorder_chunks(chunks: Column, *, seed: int = 0, level: str = "safe") -> Column:
    """Permute chunks inside their buckets: ``array<struct<slot,bucket,chunk_no,kind,text,chunk_id>>``.

    The draw depends on the seed and the chunk number alone, so equal-shaped blocks get equal
    permutations and a rerun or another partitioning changes nothing. Slots and draws are two sorted
    arrays laid side by side, O(n log n) per block; chunks that stay draw their own slot.
    """

    def draw(c: Column) -> Column:
        return F.md5(F.concat(F.lit(f"{seed}:"), c["chunk_no"].cast("string")))

    def group(c: Column) -> Column:
        return F.coalesce(bucket(c["kind"], c["pinned"], level), F.lit(""))

    def slots_of(all_chunks: Column) -> Column:
        return F.sort_array(
            F.transform(
                all_chunks, lambda c: F.struct(group(c).alias("bucket"), c["chunk_no"].alias("slot"))
            )
        )

    def draws_of(all_chunks: Column) -> Column:
        return F.sort_array(
            F.transform(
                all_chunks,
                lambda c: F.struct(
                    group(c).alias("bucket"),
                    F.when(group(c) != "", draw(c)).alias("draw"),
                    c["chunk_no"].alias("chunk_no"),
                    c["kind"].alias("kind"),
                    c["text"].alias("text"),
                    c["chunk_id"].alias("chunk_id"),
                ),
            )
        )

    def filled(slot: Column, drawn: Column) -> Column:
        return F.struct(
            slot["slot"].alias("slot"),
            F.when(slot["bucket"] != "", slot["bucket"]).alias("bucket"),
            drawn["chunk_no"].alias("chunk_no"),
            drawn["kind"].alias("kind"),
            drawn["text"].alias("text"),
            drawn["chunk_id"].alias("chunk_id"),
        )

    return bind(
        chunks, lambda cs: F.sort_array(F.zip_with(slots_of(cs), draws_of(cs), filled))
    )


def order_map(reordered: Column, level: str) -> Column:
    """``map<bucket, array<chunk_id>>`` of one reordered block, ids in slot order."""
    return bind(reordered, lambda placed: _order_map(placed, level))


def _order_map(placed: Column, level: str) -> Column:
    present = F.array_distinct(
        F.transform(F.filter(placed, lambda p: p["bucket"].isNotNull()), lambda p: p["bucket"])
    )
    if level == "safe":
        names = present
    elif level == "medium":
        names = F.array_intersect(F.array(*[F.lit(name) for name, _ in MEDIUM_BUCKETS]), present)
    else:
        names = F.array(F.lit(AGGRESSIVE_BUCKET))
    return F.map_from_entries(
        F.transform(
            names,
            lambda name: F.struct(
                name,
                F.transform(
                    F.filter(placed, lambda p: p["bucket"] == name), lambda p: p["chunk_id"]
                ),
            ),
        )
    )


def with_modules(documents: DataFrame, *, text: str = "text") -> DataFrame:
    """Add ``masked, hits, gaps`` and ``modules array<struct<module_no,module_name,text>>``."""
    return (
        documents.withColumn("_mask", mask(F.col(text), PLAIN))
        .withColumns({"masked": F.col("_mask.masked"), "hits": F.col("_mask.hits")})
        .withColumns(
            {
                "gaps": module_gaps(F.col("masked")),
                "modules": F.transform(
                    module_texts(F.col("masked")),
                    lambda m, i: F.struct(
                        i.cast("int").alias("module_no"), module_name(m).alias("module_name"), m.alias("text")
                    ),
                ),
            }
        )
        .drop("_mask")
    )


def module_table(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per module-like block of the masked texts."""
    found = with_modules(documents.select(key, text), text=text)
    return unnest(found, F.col("modules"), key, item="m").select(
        key, "m.module_no", "m.module_name", F.col("m.text").alias("module_text")
    )


def chunk_table(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per chunk: ``key, module_no, module_name, chunk_no, kind, text, pinned, chunk_id``."""
    blocks = module_table(documents, key=key, text=text)
    chunks = unnest(blocks, split_chunks(F.col("module_text")), key, "module_no", "module_name", item="c")
    return chunks.select(key, "module_no", "module_name", "c.*")


def placement_table(
    documents: DataFrame, *, key: str = "doc_id", text: str = "text", seed: int = 0, level: str = "safe"
) -> DataFrame:
    """One row per slot with the chunk that was moved into it."""
    placed = module_table(documents, key=key, text=text).withColumn(
        "_chunks", split_chunks(F.col("module_text"))
    )
    reordered = reorder_chunks(F.col("_chunks"), seed=seed, level=level)
    slots = unnest(placed, reordered, key, "module_no", "module_name", item="p")
    return slots.select(key, "module_no", "module_name", "p.*")


def shuffle_documents(
    documents: DataFrame, *, text: str = "text", seed: int = 0, level: str = "safe"
) -> DataFrame:
    """Replace ``text`` by its reordered form and add ``chunk_order`` and ``order_json``.

    ``chunk_order`` lists every block by position; ``order_json`` is the name-keyed map, in which a
    repeated block name keeps its first position and its last order.
    """
    staged = with_modules(documents, text=text).withColumn(
        "_blocks",
        F.transform(
            "modules",
            lambda m: F.struct(
                m["module_no"].alias("module_no"),
                m["module_name"].alias("module_name"),
                split_chunks(m["text"]).alias("chunks"),
            ),
        ),
    )
    placed = staged.withColumn(
        "_blocks",
        F.transform(
            "_blocks",
            lambda b: F.struct(
                b["module_no"].alias("module_no"),
                b["module_name"].alias("module_name"),
                reorder_chunks(b["chunks"], seed=seed, level=level).alias("placed"),
            ),
        ),
    )
    def body(blocks: Column, i: Column) -> Column:
        texts = F.transform(F.get(blocks, i)["placed"], lambda p: p["text"])
        return F.coalesce(F.array_join(texts, ""), F.lit(""))

    rebuilt = bind(
        F.col("_blocks"),
        lambda blocks: F.array_join(
            F.transform("gaps", lambda gap, i: F.concat(gap, body(blocks, i))), ""
        ),
    )
    order = F.transform(
        "_blocks",
        lambda b: F.struct(
            b["module_no"].alias("module_no"),
            b["module_name"].alias("module_name"),
            order_map(b["placed"], level).alias("order"),
        ),
    )

    def by_name(blocks: Column) -> Column:
        names = F.array_distinct(F.transform(blocks, lambda b: b["module_name"]))
        return F.map_from_entries(
            F.transform(
                names,
                lambda name: F.struct(
                    name, F.element_at(F.filter(blocks, lambda b: b["module_name"] == name), -1)["order"]
                ),
            )
        )

    return (
        placed.withColumns({text: unmask(rebuilt, F.col("hits"), PLAIN), "chunk_order": order})
        .withColumn("order_json", F.to_json(bind(F.col("chunk_order"), by_name)))
        .drop("masked", "hits", "gaps", "modules", "_blocks")
    )
