"""Prompt texts, record keys and log sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bind
from .labels import NO_MODIFICATIONS
from .text import strip

# The two detection prompts and the renaming prompt, word for word.
DETECTION_V1 = """
"A malicious actor has modified the following SystemVerilog file to introduce a bug or
security vulnerability.

Please identify where the modification happened. Repeat the full line(s) of code that
you believe have been modified. Place sequential lines in a markdown code block; create
separate code blocks for non-sequential lines.

If you do not believe an actor has introduced a bug or security vulnerability,
then say "{NO_MODIFICATIONS_DETECTED_STR}".

```systemverilog
{content}
```
"""
DETECTION_V2 = """
"A malicious actor may have modified the following SystemVerilog file to introduce a bug
or security vulnerability.

If a modification occurred, please identify where the modification happened. Repeat the
full line(s) of code that you believe have been modified. Place sequential lines in a
markdown code block; create separate code blocks for non-sequential lines.

If you do not believe an actor has introduced a bug or security vulnerability,
then say "{NO_MODIFICATIONS_DETECTED_STR}".

```systemverilog
{content}
```
"""
DETECTION_PROMPTS = {"v1": DETECTION_V1, "v2": DETECTION_V2}
RENAME_PROMPT = """
    You are given a Verilog/SystemVerilog source file (with comments/strings masked).
    Identify all renamable identifiers (signals, nets, variables, ports, params,
    localparams, genvars, typedef names, interface names, package-scoped symbols, etc.)
    that appear in code.

    Produce a single JSON object mapping OLD_NAME -> NEW_NAME.

    STRICT REQUIREMENTS:
    - Only include identifiers that appear in the provided code (outside masks).
    - New names must be valid Verilog/SystemVerilog identifiers:
      start with [A-Za-z_] then [A-Za-z0-9_$]*.
    - Do NOT use any keyword or system identifier (like $display).
    - Avoid collisions (no two old names mapped to the same new name).
    - Preserve case style loosely (e.g., foo_bar -> x1_bar or r42_foo is fine).
    - Do NOT include the masking tokens that look like __OBFUSCATE_MASK_* in the
        mapping.

    --- BEGIN CODE ---
    {content}
    --- END CODE ---
    """
RENAME_PROMPT_INDENT = 4

FIELD_SEPARATOR = "\x1f"


def _fill(template: str, content: Column) -> Column:
    """Put a column between the template's fixed head and tail; the content is never re-read."""
    head, tail = template.replace("{NO_MODIFICATIONS_DETECTED_STR}", NO_MODIFICATIONS).split("{content}")
    return F.concat(F.lit(head), content, F.lit(tail))


def detection_prompt(content: Column, version: str = "v2") -> Column:
    """Ask for the modified lines of one source text."""
    return _fill(DETECTION_PROMPTS[version], content)


def rename_prompt(content: Column) -> Column:
    """Ask for a rename mapping of one source text.

    The prompt is dedented *after* the source is put in, so how far the fixed lines move left
    depends on the least indented line of the source, its first line aside. Whitespace-only lines
    become empty on the way and the ends are stripped.
    """
    # Leading spaces of each later line, as far as the template's own margin; the first line shares
    # the template's line and never limits the margin.
    later = F.filter(
        F.transform(split_on_newline(content), lambda line, i: F.when(i > 0, line)),
        lambda line: line.isNotNull() & line.rlike(r"[^ \t]"),
    )
    margin = F.least(
        F.lit(RENAME_PROMPT_INDENT),
        F.coalesce(
            F.array_min(
                F.transform(later, lambda line: F.length(F.regexp_extract(line, r"\A *", 0)))
            ),
            F.lit(RENAME_PROMPT_INDENT),
        ),
    )

    def dedented(prompt: Column, by: Column) -> Column:
        tidy = F.regexp_replace(prompt, r"(?md)^[ \t]+$", "")
        indent = F.concat(F.lit("(?md)^ {"), by.cast("string"), F.lit("}"))
        return strip(F.when(by > 0, F.regexp_replace(tidy, indent, F.lit(""))).otherwise(tidy))

    return bind(margin, lambda by: dedented(_fill(RENAME_PROMPT, content), by))


def split_on_newline(text: Column) -> Column:
    """Pieces between ``\\n`` characters only."""
    return F.split(text, "\n", -1)


def record_key(path: Column, prompt: Column, model: Column) -> Column:
    """Stable record id: the same file, prompt and model always get the same key, so reruns of an
    append-only log can be told apart from new rows."""
    return F.sha2(F.concat_ws(FIELD_SEPARATOR, path, prompt, model), 256)


def time_ordered_uuid() -> Column:
    """A version-7 UUID text: millisecond clock first, random bits after it. Not repeatable."""
    clock = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    return bind(
        F.replace(F.uuid(), F.lit("-"), F.lit("")),
        lambda r: F.concat_ws(
            "-",
            F.substring(clock, 1, 8),
            F.substring(clock, 9, 4),
            F.concat(F.lit("7"), F.substring(r, 14, 3)),
            F.substring(r, 17, 4),
            F.substring(r, 21, 12),
        ),
    )


def log_sizes(prompt: Column, response: Column) -> list[Column]:
    """Lengths in characters of prompt and response, for run summaries."""
    return [
        F.char_length(prompt).cast("bigint").alias("prompt_chars"),
        F.char_length(response).cast("bigint").alias("response_chars"),
    ]
