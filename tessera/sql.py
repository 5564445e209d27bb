"""DuckDB text expressions for the oracles, in the terms of functions.text."""

from __future__ import annotations

from tessera.functions.text import NUMBER, STOP_WORDS

CJK = "[一-鿿]"


def quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+\z', '', 'g')"


def normalize_whitespace(x: str) -> str:
    x = rf"regexp_replace({x}, '[\x00\r]', '', 'g')"
    x = rf"regexp_replace({x}, '[ \t]+\n', chr(10), 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    x = rf"regexp_replace({x}, '[ \t]{{2,}}', ' ', 'g')"
    return strip(x)


def normalize_search(x: str) -> str:
    return f"trim(regexp_replace(lower({normalize_whitespace(x)}), '[^a-z0-9一-鿿]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[A-Za-z0-9]+|{CJK}'), lambda t: lower(t))"


def terms(x: str) -> str:
    return f"list_filter({tokens(x)}, lambda t: (length(t) > 1 OR regexp_matches(t, '{CJK}')) AND t NOT IN ({quoted(STOP_WORDS)}))"


def term_set(x: str) -> str:
    return f"list_distinct({terms(x)})"


def raw_sentences(x: str) -> str:
    """Pieces between sentence ends, which DuckDB can't look behind for."""
    marked = rf"regexp_replace({normalize_whitespace(x)}, '([.!?。！？])\s+', '\1' || chr(1), 'g')"
    return rf"regexp_split_to_array({marked}, '\x01|\n+')"


def canonical_sentences(x: str) -> str:
    s = rf"regexp_replace(regexp_replace(lower(s), '{NUMBER}', '<num>', 'g'), '\s+', ' ', 'g')"
    return f"list_distinct(list_filter(list_transform({raw_sentences(x)}, lambda s: {strip(s)}), lambda s: s <> ''))"


def number(n: str) -> str:
    """A number without thousands separators, leading zeros and trailing decimal zeros."""
    plain = rf"regexp_replace(lower({n}), '[.,]+\z', '')"
    whole = rf"regexp_replace(replace(regexp_extract({plain}, '^\$?(\d[\d,]*)', 1), ',', ''), '^0+(\d)', '\1')"
    part = rf"regexp_replace(regexp_extract({plain}, '^\$?\d[\d,]*\.(\d+)', 1), '0+\z', '')"
    text = f"CASE WHEN {plain} LIKE '$%' THEN '$' ELSE '' END || {whole} || CASE WHEN {part} = '' THEN '' ELSE '.' || {part} END || CASE WHEN {plain} LIKE '%\\%' ESCAPE '\\' THEN '%' ELSE '' END"
    return rf"CASE WHEN regexp_matches({plain}, '^\$?\d[\d,]*(\.\d+)?%?\z') THEN {text} ELSE {plain} END"


def numeric_tokens(x: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({normalize_whitespace(x)}, '{NUMBER}'), lambda n: {number('n')}))"


def canonical(s: str) -> str:
    """A sentence in lower case, numbers as <num>, white space collapsed."""
    return strip(rf"regexp_replace(regexp_replace(lower({s}), '{NUMBER}', '<num>', 'g'), '\s+', ' ', 'g')")


def matches(x: str, pattern: str) -> str:
    """Does a pattern of the operators, written without look-around, occur?"""
    return f"regexp_matches({x}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def fixed(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def chunks(size: int = 900, overlap: int = 180) -> str:
    """doc_id, chunk_index, chunk_text of the fixed windows over documents."""
    step = max(1, size - min(overlap, size - 1))
    return f"""
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index, chunk_text
        FROM (
            SELECT doc_id, start, {strip(f"substring(body, start + 1, {size})")} AS chunk_text
            FROM (
                SELECT doc_id, body, unnest(range(0, greatest(length(body), 1), {step})) AS start
                FROM (SELECT doc_id, {normalize_whitespace("text")} AS body FROM documents WHERE text IS NOT NULL)
            )
            WHERE start = 0 OR start + {size - step} < length(body)
        )
        WHERE chunk_text <> ''
    """
