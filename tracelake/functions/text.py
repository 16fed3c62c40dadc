"""Text functions as Column expressions."""

from __future__ import annotations

import string
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters per token, words per hash block, characters per hash block.
CHARS_PER_TOKEN = 4.0
WORDS_PER_BLOCK = 384
BLOCK_TOKENS = 512
HASH_MASK = 0xFFFFFF
LABEL_MAX_CHARS = 60

SPACE = r"(?U)\s+"


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def normalize_text(c: Column) -> Column:
    """Lower-case, trim and collapse whitespace."""
    return F.trim(F.regexp_replace(F.lower(c), SPACE, " "))


def words(c: Column) -> Column:
    """Whitespace-separated words, none empty."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def chars_per_word(c: Column) -> Column:
    return F.length(c) / F.greatest(word_count(c), F.lit(1))


def token_estimate(chars: Column) -> Column:
    """``max(1, round(chars/4))`` with ties to even."""
    return F.greatest(F.lit(1), F.bround(chars / F.lit(CHARS_PER_TOKEN))).cast("long")


def chars_for_tokens(tokens: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(tokens * F.lit(CHARS_PER_TOKEN))).cast("long")


def prompt_tokens(c: Column) -> Column:
    """``max(1, len // 3)``, 0 for an empty prompt."""
    n = F.length(c)
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 3))).cast("long")


def natural_truncate(c: Column, max_tokens: Column) -> Column:
    """Cut at the last separator found after a third of the budget, paragraph breaks first."""
    budget = chars_for_tokens(max_tokens)
    cut = F.left(c, budget.cast("int"))

    def last_at(sep: str) -> Column:
        # 0-based position of the last occurrence, -1 when absent
        at = F.locate(sep[::-1], F.reverse(cut))
        return F.when(at > 0, F.length(cut) - at + 1 - len(sep)).otherwise(F.lit(-1))

    out = F.lit(None).cast("string")
    for sep in reversed(["\n\n", "\n", ". ", "? ", "! "]):
        pos = last_at(sep)
        kept = F.left(cut, (pos + len(sep.rstrip())).cast("int"))
        out = F.when(pos > F.floor(budget / 3), kept).otherwise(out)
    return F.when(token_estimate(F.length(c)) <= max_tokens, c).otherwise(rstrip(F.coalesce(out, cut)))


def hash_block(c: Column) -> Column:
    """Low 24 bits of the CRC-32 of the UTF-8 bytes."""
    return F.crc32(F.encode(c, "UTF-8")).bitwiseAND(F.lit(HASH_MASK))


def word_block_hashes(c: Column) -> Column:
    """One hash per 384 words; a blank text has one block."""
    w = words(c)
    blocks = F.greatest(F.lit(1), F.ceil(F.size(w) / F.lit(WORDS_PER_BLOCK))).cast("int")
    return F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda k: hash_block(F.array_join(F.slice(w, k * WORDS_PER_BLOCK + 1, WORDS_PER_BLOCK), " ")),
    )


def char_block_hashes(c: Column, input_length: Column) -> Column:
    """``ceil(len/512)`` hashes over fixed character blocks, padded with ``__pad_k``."""
    size = int(BLOCK_TOKENS * CHARS_PER_TOKEN)
    blocks = F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(1), input_length) / F.lit(BLOCK_TOKENS))).cast("int")

    def one(k: Column) -> Column:
        part = F.substring(c, k * size + 1, F.lit(size))
        return hash_block(F.when(part == "", F.concat(F.lit("__pad_"), k.cast("string"))).otherwise(part))

    return F.transform(F.sequence(F.lit(0), blocks - 1), one)


def list_or_string(c: Column) -> Column:
    """A VARIANT holding a list of strings or one string, as newline-joined text."""
    return F.coalesce(
        F.array_join(F.try_variant_get(c, "$", "array<string>"), "\n"),
        F.try_variant_get(c, "$", "string"),
        F.lit(""),
    )


# Letters with a bar that the folding keeps as their base letter.
_BARRED = {"đ": "d"}


@cache
def fold_table() -> dict[str, str]:
    """What the folding makes of each character of the code table, where that is not the character itself: its compatibility
    decomposition in lower case, of which letters a to z and digits of any script stay."""
    table = {}
    for code in (*range(0xD800), *range(0xE000, 0x110000)):
        char = chr(code)
        base = "".join(x for ch in unicodedata.normalize("NFKD", char.lower()) if (x := _BARRED.get(ch, ch)) in string.ascii_lowercase or x.isdigit())
        if base and base != char:
            table[char] = base
    return table


def _ranges(codes: list[int]) -> str:
    """Ascending code points as the ranges of a character class."""
    starts = [c for c, before in zip(codes, [-2, *codes]) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -2]) if c + 1 != after]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


@cache
def _kept() -> str:
    """Ranges of the characters that the folding keeps."""
    return _ranges([code for code in (*range(0xD800), *range(0xE000, 0x110000)) if chr(code) in string.ascii_lowercase or chr(code).isdigit()])


def fold_latin(c: Column) -> Column:
    """Lower-case, base letters and digits of all characters (ligatures and such spelt out), nothing else; stays in the JVM.

    The large classes are asked only of characters outside ASCII: a class costs as many steps as it has ranges.
    """
    one = {k: v for k, v in fold_table().items() if len(v) == 1 and not k.isascii()}
    many = {k: v for k, v in fold_table().items() if len(v) > 1}
    spelt = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])
    other, rare = r"[^\x00-\x7f]", _ranges(sorted(map(ord, many)))

    def spell(t: Column) -> Column:
        chars = F.transform(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)), lambda x: F.coalesce(F.try_element_at(spelt, x), x))
        whole = F.when(F.rlike(t, F.lit(f"(?={other})[{rare}]")), F.array_join(chars, "")).otherwise(t)
        return F.regexp_replace(whole, f"(?:(?={other})[^{_kept()}])+", "")

    def fold(s: Column) -> Column:
        based = F.transform(F.array(F.translate(s, "".join(one), "".join(one.values()))), spell)
        return F.when(F.rlike(s, F.lit(other)), F.get(based, 0)).otherwise(s)

    # inside a lambda a text is worked out once, however often it is read
    return F.get(F.transform(F.array(F.regexp_replace(F.lower(c), r"[\x00-/:-`{-\x7f]+", "")), fold), 0)


def containment_similarity(a: Column, b: Column) -> Column:
    """1 when equal, length ratio for a prefix, 0.9 of it when contained, else 0 (folded inputs)."""
    la, lb = F.length(a), F.length(b)
    ratio = F.least(la, lb) / F.greatest(la, lb)
    return (
        F.when((la == 0) | (lb == 0), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when(F.startswith(a, b) | F.startswith(b, a), ratio)
        .when(F.contains(a, b) | F.contains(b, a), ratio * F.lit(0.9))
        .otherwise(F.lit(0.0))
    )


def label_head(line: Column) -> Column:
    """Text before the first ``:`` when it is 1 to 60 characters, else null."""
    head = F.trim(F.substring_index(line, ":", 1))
    return F.when(F.contains(line, F.lit(":")) & F.length(head).between(1, LABEL_MAX_CHARS), head)


def first_label(lines: Column) -> Column:
    """First usable label head of an array of lines."""
    return F.get(F.filter(F.transform(lines, label_head), lambda h: h.isNotNull()), 0)


def cut_markers(c: Column) -> Column:
    """Drop everything from a thinking tag or a second assistant turn on."""
    t = strip(c)
    return strip(F.regexp_replace(t, r"(?is)(?<=.)(<think>|\r?\nassistant).*$", ""))


def cut_decoded(c: Column) -> Column:
    """Drop a second assistant turn and anything from an end marker on."""
    t = F.regexp_replace(strip(c), r"(?is)\nassistant\n.*$", "")
    return strip(F.regexp_replace(t, r"(?s)(</html>|<\|endoftext\|>|<\|im_end\|>).*$", ""))


def from_first_div(c: Column) -> Column:
    """Drop fence lines and everything before the first ``<div``."""
    t = strip(c)
    inner = F.regexp_replace(F.regexp_replace(t, r"^[^\n]*(\n|$)", ""), r"(?m)^```.*(\n|$)", "")
    t = F.when(F.startswith(t, F.lit("```")), strip(inner)).otherwise(t)
    at = F.locate("<div", F.lower(t))
    return strip(F.when(at > 1, F.substr(t, at)).otherwise(t))


def looks_incomplete(c: Column) -> Column:
    """The text ends in a hyphen or its last line has no closing punctuation."""
    t = rstrip(c)
    last = strip(F.element_at(F.split(t, "\n"), -1))
    return (
        F.when(F.rlike(t, F.lit(r"-$")), True)
        .when(last == "", True)
        .when(F.rlike(last, F.lit("[.!?…]['\")\\]]?$")), False)
        .when(F.rlike(last, F.lit(r"[.!?:;]$")), False)
        .otherwise(True)
    )


# Line starts that begin a new field.
HEADER_STARTS = (
    "Chẩn bệnh", "Họ tên", "Ngày sinh", "Giường", "Buồng", "Ngày vào", "Mã số", "Bộ Y tế", "Ghi chú", "Người lập",
)


def looks_continuation(c: Column) -> Column:
    """The first line starts in lower case, a digit or an opening mark, and is no field header."""
    first = strip(F.element_at(F.split(lstrip(c), "\n"), 1))
    head = F.substring(first, 1, 1)
    return (
        F.when(F.rlike(first, F.lit("(?iu)^(" + "|".join(HEADER_STARTS) + ")")), False)
        .when(first == "", True)
        .when(F.rlike(head, F.lit(r"^[\p{Ll}\p{Nd}\"'(\[]")), True)
        .otherwise(False)
    )


def should_stitch(a: Column, b: Column) -> Column:
    """Both texts are non-blank and the first runs on into the second."""
    sa, sb = strip(a), strip(b)
    return (sa != "") & (sb != "") & (
        F.rlike(sa, F.lit(r"-$")) | (looks_incomplete(sa) & looks_continuation(sb))
    )


def bad_output_flags(c: Column) -> Column:
    """Issue names of a model output."""
    t = strip(c)
    w = words(t)
    return F.array_compact(
        F.array(
            F.when(t == "", F.lit("empty")),
            F.when(F.length(t) < 3, F.lit("too_short")),
            F.when(
                F.size(w) >= 16,
                F.when(F.size(F.array_distinct(F.slice(w, -16, 16))) <= 3, F.lit("repeated_tail")),
            ),
            F.when(F.contains(t, F.lit("�")), F.lit("replacement_char")),
        )
    )


def row_cells(row: Column) -> Column:
    """Cell texts of one table row."""
    return F.transform(
        F.regexp_extract_all(row, F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)),
        lambda x: F.regexp_replace(strip(x), SPACE, " "),
    )


def row_fingerprint(row: Column, cells: Column | None = None) -> Column:
    """Structure of a table row: cells, spans, text lengths, numeric cells."""
    cells = row_cells(row) if cells is None else cells
    return F.struct(
        F.size(cells).alias("n_cells"),
        F.regexp_count(row, F.lit(r"(?i)(rowspan|colspan)\s*=\s*['\"]?\d+")).alias("n_spans"),
        F.transform(cells, F.length).alias("cell_lens"),
        F.size(F.filter(cells, lambda x: F.rlike(F.replace(x, F.lit(" "), F.lit("")), F.lit(r"^[\d.,]+$")))).alias(
            "n_numeric"
        ),
    )


def is_header_like(fp: Column) -> Column:
    return (fp["n_spans"] > 0) | ((fp["n_cells"] >= 8) & (fp["n_numeric"] >= fp["n_cells"] - 2))


def rows_equivalent(a: Column, b: Column) -> Column:
    """Same text after normalising, or the same structure."""
    fa, fb = row_fingerprint(a), row_fingerprint(b)
    same = (fa["n_cells"] == fb["n_cells"]) & (fa["n_spans"] == fb["n_spans"]) & (fa["cell_lens"] == fb["cell_lens"])
    return (normalize_text(a) == normalize_text(b)) | same


def row_number_cell(cells: Column) -> Column:
    """Integer in the first of a row's cells, else null."""
    first = F.get(cells, 0)
    return F.when(F.rlike(first, F.lit(r"^\d+$")), first.try_cast("long"))


def encode_prompt(c: Column) -> Column:
    """Base64 of the UTF-8 bytes, without line breaks."""
    return F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"[\r\n]", "")


def decode_prompt(encoded: Column, plain: Column) -> Column:
    """Decoded prompt, else the plain column, else ''."""
    return F.coalesce(F.decode(F.unbase64(encoded), "UTF-8"), plain, F.lit(""))


def prompt_from_chat(payload: Column) -> Column:
    """Prompt text of a chat payload JSON: message contents, else ``prompt`` (string or list)."""
    p = F.from_json(payload, "struct<messages: array<struct<content: variant>>, prompt: variant>")
    none = F.array().cast("array<string>")

    def block_text(b: Column) -> Column:
        """Text of a block of type text; null for anything else, whatever its shape."""
        text = F.try_variant_get(b, "$.text", "variant")
        is_text = (F.try_variant_get(b, "$.type", "string") == "text") & (F.schema_of_variant(text) == "STRING")
        return F.when(is_text, F.try_variant_get(text, "$", "string"))

    def message_parts(m: Column) -> Column:
        """Texts of one message; none for a message without content, as tool calls are."""
        whole = F.when(F.schema_of_variant(m["content"]) == "STRING", F.array(F.try_variant_get(m["content"], "$", "string")))
        blocks = F.transform(F.try_variant_get(m["content"], "$", "array<variant>"), block_text)
        return F.coalesce(whole, blocks, none)

    parts = F.filter(F.flatten(F.transform(p["messages"], message_parts)), lambda x: x.isNotNull())
    return (
        F.when(F.size(parts) > 0, F.array_join(parts, "\n"))
        .otherwise(list_or_string(p["prompt"]))
    )


def prefix_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256, '' for an empty prompt."""
    return F.when(text == "", F.lit("")).otherwise(F.left(F.sha2(text, 256), F.lit(16)))


def environment_slug(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("unknown")).otherwise(
        F.lower(F.replace(F.substring_index(name, "/", -1), F.lit("-v1"), F.lit("")))
    )


def escape_html(c: Column, quote: bool = True) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
    if quote:
        pairs += [('"', "&quot;"), ("'", "&#x27;")]
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def compact_text(c: Column, limit: int) -> Column:
    """Newlines to spaces; longer texts are cut to ``limit`` characters ending in ``...``."""
    t = F.replace(strip(c), F.lit("\n"), F.lit(" "))
    return F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit - 3)), F.lit("..."))).otherwise(t)
