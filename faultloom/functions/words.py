"""Reserved words of the source language and the candidate-name test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
KEYWORDS = (
    "module", "endmodule", "input", "output", "inout", "wire", "reg", "logic", "assign", "always",
    "begin", "end", "if", "else", "for", "while", "case", "endcase", "parameter", "localparam",
    "generate", "endgenerate", "genvar", "function", "endfunction", "task", "endtask", "signed",
    "unsigned", "int", "integer", "real", "time", "repeat", "posedge", "negedge", "default",
    "package", "import", "export", "class", "endclass", "new", "this", "virtual", "interface",
    "endinterface", "typedef", "struct", "enum", "union", "covergroup", "cover", "fork", "join",
    "unique", "priority", "local", "static",
)
DECLARATION_KEYWORDS = (
    "wire", "reg", "logic", "input", "output", "inout", "parameter", "localparam", "genvar",
    "integer", "int", "bit", "byte", "shortint",
)
SYSTEM_IDENTIFIERS = ("$display", "$finish", "$time", "$random", "$clog2")
MASK_PREFIX = "__OBFUSCATE_MASK_"

RESERVED = tuple(dict.fromkeys(KEYWORDS + DECLARATION_KEYWORDS + SYSTEM_IDENTIFIERS))


def is_reserved(name: Column) -> Column:
    """Membership in the fixed reserved list (a hash lookup inside the generated code, no join)."""
    return name.isin(*RESERVED)


def is_candidate(name: Column) -> Column:
    """True for a name worth renaming: not empty, reserved, all digits, escaped or a placeholder."""
    return ~(
        (name == "")
        | is_reserved(name)
        | name.rlike(r"\A\p{Nd}+\z")
        | name.startswith("\\")
        | name.startswith(MASK_PREFIX)
    )
