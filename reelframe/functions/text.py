"""Text functions as Columns. Patterns use explicit ASCII classes, so that engines agree on them."""

from __future__ import annotations

from functools import reduce
from html import entities

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\r\x0b\x0c]"

# What users of the data model expect in results.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
QUESTION_PREFIXES = ('"question": ', 'question": ', "'question': ", "question: ")
KEYWORD_STOPWORDS = (
    "the", "and", "with", "then", "that", "have", "this", "from", "into", "what", "which", "when", "were", "will", "like", "left",
    "right", "top", "bottom", "front", "rear", "back", "show", "showing", "shows", "look", "looks", "looking", "please", "tell",
    "explain", "how", "why", "where", "who", "whom", "whose", "does", "did", "doing", "done", "make", "made", "press", "pressed",
    "pressing", "step", "first", "second", "third", "final", "begin", "end", "start", "stop", "turn", "on", "off",
)
VISUAL_STOPWORDS = KEYWORD_STOPWORDS + (
    "a", "an", "of", "in", "at", "to", "for", "is", "it", "are", "be", "as", "by", "or",
)
VISUAL_SYNONYMS = {
    "people": "person", "persons": "person", "men": "man", "women": "woman", "kids": "child", "children": "child", "screens": "screen",
    "monitor": "screen", "monitors": "screen", "display": "screen", "displays": "screen", "screenshots": "screen", "cars": "car",
    "vehicle": "car", "vehicles": "car", "automobile": "car", "autos": "car", "bikes": "bike", "bicycle": "bike", "bicycles": "bike",
    "buttons": "button", "key": "button", "keys": "button", "computers": "computer", "laptops": "laptop", "phones": "phone",
    "smartphone": "phone", "smartphones": "phone", "menubar": "menu", "menus": "menu", "flags": "flag", "buildings": "building",
    "tables": "table", "microphones": "microphone", "cameras": "camera",
}
SUFFIX_RULES = (
    ("ingly", "ing"), ("sses", "ss"), ("ies", "y"), ("ing", ""), ("ized", "ize"), ("ises", "ise"), ("ied", "y"), ("ers", "er"),
    ("ives", "ife"), ("ves", "f"), ("s", ""),
)
SPECULATION = (
    "maybe", "might", "seems", "seem", "appears", "appear", "appear to", "suggests", "suggest", "symbolize", "symbolizes", "symbolise",
    "symbolises", "represent", "represents", "possibly", "perhaps",
)
MODEL_TAGS = (("internvl", "InternVL"), ("qwen", "qwen"), ("llama", "llama"), ("gemma", "gemma"), ("minicpm", "minicpm"))
API_TAGS = ("claude", "gemini", "gpt")
PROVIDERS = {
    "openai": "chatgpt", "chatgpt": "chatgpt", "gpt": "chatgpt", "gpt4": "chatgpt", "gpt-4": "chatgpt", "gpt-4o": "chatgpt",
    "custom": "gemini", "gemini": "gemini", "anthropic": "claude", "claude": "claude",
}
FIELD_SEPARATOR = "<SEP>"


def strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once however often use mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def quoted(marker: str) -> str:
    """A pattern for exactly marker, in any regular-expression dialect."""
    return "".join(c if c.isalnum() or c in " _<>#" or ord(c) > 127 else {"\n": r"\n", "\t": r"\t", "\r": r"\r"}.get(c, "\\" + c) for c in marker)


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(" \t\n\r\x0b\x0c"))


def squeeze(c: Column) -> Column:
    """White-space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def words(c: Column) -> Column:
    """Parts between white space, none empty."""
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def code_point(n: Column) -> Column:
    """The character of a number; null where there is none."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _numeric(number: Column) -> Column:
    """The character that a numeric reference stands for by HTML's rules: Windows-1252's for 128 to 159, U+FFFD where
    there can be none, nothing for control characters and non-characters."""
    windows = {n: (bytes([n]).decode("cp1252", "ignore") or chr(n)) for n in range(0x80, 0xA0)}
    special = F.element_at(F.create_map(*(F.lit(x) for kv in {0: "\ufffd", 13: "\r", **windows}.items() for x in kv)), number.cast("int"))
    nothing = number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127) | number.between(0xFDD0, 0xFDEF) | (F.pmod(number, F.lit(0x10000)) >= 0xFFFE)
    beyond = number.isNull() | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    return F.when(beyond, "\ufffd").when((number == 0) | (number == 13) | number.between(0x80, 0x9F), special).when(nothing, "").otherwise(code_point(number))


def _reference(part: Column) -> Column:
    """What follows an ampersand, with the reference that it begins with, if any, replaced, else with the ampersand."""
    # as one literal: thousands of them would keep the planner busy
    names = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in entities.html5.items())), F.lit("\x02"), F.lit("\x01"))
    # names that need no semicolon may be followed by anything, the longest counts
    bare = "|".join(sorted((n for n in entities.html5 if n[-1] != ";"), key=len, reverse=True))
    digits, hexes = F.regexp_extract(part, "^#([0-9]+);?", 1), F.regexp_extract(part, "^#[xX]([0-9a-fA-F]+);?", 1)
    # seven figures are beyond any character, so is what doesn't fit a long
    significant = lambda d: F.regexp_replace(d, "^0+(?=.)", "")
    number = F.when(digits != "", significant(digits).try_cast("long")).when(F.length(significant(hexes)) <= 7, F.conv(significant(hexes), 16, 10).cast("long"))
    after = lambda pattern: F.regexp_replace(part, pattern, "")

    def named(name: Column) -> Column:
        whole = F.try_element_at(names, name)
        short = F.regexp_extract(name, f"^(?:{bare})", 0)
        rest = lambda n: F.substr(part, F.length(n) + 1)
        return F.when(whole.isNotNull(), F.concat(whole, rest(name))).when(short != "", F.concat(F.try_element_at(names, short), rest(short))).otherwise(F.concat(F.lit("&"), part))

    is_number = (digits != "") | (hexes != "")
    # the frequent ones are known without a pattern
    known = reduce(lambda w, n: w.when(F.startswith(part, F.lit(n)), F.concat(F.lit(entities.html5[n]), F.substr(part, F.lit(len(n) + 1)))), ("lt;", "gt;", "quot;", "nbsp;", "apos;", "AMP;"), F.when(F.startswith(part, F.lit("amp;")), F.concat(F.lit("&"), F.substr(part, F.lit(5)))))
    return known.when(is_number, F.concat(_numeric(number), after("^#(?:[0-9]+|[xX][0-9a-fA-F]+);?"))).otherwise(let(F.regexp_extract(part, r"^[^\t\n\f <&#;]{1,32};?", 0), named))


def unescape_html(c: Column) -> Column:
    """Every named and numeric character reference of HTML 5, with or without its semicolon, once; texts without an
    ampersand stay as they are."""
    done = lambda parts: F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), _reference), ""))
    # where all are ampersands' own, which needs no list of parts
    plain = F.regexp_replace(c, "&(?:amp|AMP);", "&")
    return F.when(~F.contains(c, F.lit("&")), c).when(~F.rlike(c, F.lit("&(?!(?:amp|AMP);)")), plain).otherwise(let(F.split(c, "&", -1), done))


def clean_str(c: Column) -> Column:
    """Strip, unescape, drop control characters; texts without any of these stay as they are."""
    done = F.regexp_replace(unescape_html(strip(c)), r"[\x00-\x1f\x7f-\x9f]", "")
    return F.when(F.rlike(c, F.lit(r"[&\x00-\x1f\x7f-\x9f]|^ | \z")), done).otherwise(c)


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition, by the library that Spark's collations bring along; ASCII texts stay as they are."""
    composed = F.try_reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    return F.when(F.rlike(c, F.lit(r"[^\x00-\x7f]")), composed).otherwise(c)


def split_markers(c: Column, markers: list[str]) -> Column:
    """Split at any of the literal markers; stripped parts that aren't empty."""
    if not markers:
        return F.array(c)
    pattern = "|".join(quoted(m) for m in sorted(markers, key=len, reverse=True))
    return F.filter(F.transform(F.split(c, pattern), strip), lambda p: p != "")


def _outer_quotes(c: Column) -> Column:
    c = strip(c)
    for _ in range(4):
        c = F.regexp_replace(c, f"(?s)^([\"']){WS}*(.*?){WS}*\\1$", "$2")
    return c


def normalize_question(c: Column) -> Column:
    """The question in a line like `"question": "...",`: no prefix, trailing commas or outer quotes (four deep)."""
    c = strip(F.coalesce(c, F.lit("")))
    c = F.when(F.length(c) >= 2, strip(F.regexp_replace(c, "^[\"']", ""))).otherwise(c)
    c = strip(F.regexp_replace(c, "^(?:" + "|".join(quoted(p) for p in QUESTION_PREFIXES) + ")", ""))
    c = F.regexp_replace(c, f"(?:{WS}*,)+$", "")
    inner = F.regexp_extract(c, rf'question"?{WS}*:{WS}*"(.+?)"{WS}*,?{WS}*$', 1)
    return _outer_quotes(F.when(inner != "", inner).otherwise(c))


def strip_fences(c: Column) -> Column:
    return strip(F.regexp_replace(c, "```(?:json)?", ""))


def json_block(c: Column) -> Column:
    """From the first { to the last }; else the text."""
    block = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(block != "", block).otherwise(c)


def extract_answer(c: Column, depth: int = 3) -> Column:
    """The innermost `answer` of a reply: prefixes and code fences off, JSON opened up to `depth` times,
    else what follows "answer":; outer quotes and a lone trailing brace off."""
    c = strip(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(c, rf"(?i)^here'?s the requested synthesis:{WS}*", "")
    c = F.regexp_replace(c, rf"(?i)^answer{WS}*:{WS}*", "")
    def opened(best: Column) -> Column:
        found = lambda block: F.coalesce(*(F.get_json_object(block, f"$.{k}") for k in ("answer", "Answer", "ANSWER")))
        return F.coalesce(strip(let(json_block(best), found)), best)

    best = strip_fences(c)
    for _ in range(depth):
        best = let(best, opened)
    after = lambda x: let(F.regexp_extract(x, rf'(?is)["\']answer["\']{WS}*:{WS}*(.+)', 1), lambda tail: F.when(tail != "", tail).otherwise(x))
    best = strip(let(best, after))
    best = F.regexp_replace(F.regexp_replace(best, f'(?s)^"{WS}*(.*?){WS}*"$', "$1"), f"(?s)^'{WS}*(.*?){WS}*'$", "$1")
    return strip(F.regexp_replace(best, r"[,\s]*\}$", ""))


def normalize_ocr(c: Column) -> Column:
    """Compatibility composition, lower case; runs of all but ASCII letters, digits and CJK become a space."""
    return F.trim(F.regexp_replace(F.lower(nfkc(F.coalesce(c, F.lit("")))), r"[^0-9a-z\x{4e00}-\x{9fff}]+", " "))


def token_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_ocr(c), " "), lambda w: w != ""))


def keypoint_words(c: Column, months: str = "prefix") -> Column:
    """The words of a normalised keypoint: lower case, punctuation to spaces, ordinals to numbers, months to full names.

    months: "prefix" takes any word that starts like a month for it (`market` becomes `march`), as the metric
    is defined; "strict" takes only names and three-letter forms; "none" leaves words alone.
    """
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^0-9a-z\x{4e00}-\x{9fa5} \t\n\r]+", " ")
    c = F.regexp_replace(c, r"\b([0-9]+)(?:st|nd|rd|th)\b", "$1")
    if months == "none":
        return words(c)
    names, short = strings(MONTHS), strings([m[:3] for m in MONTHS])

    def full(w: Column, at: Column) -> Column:
        name = F.element_at(names, F.when(at > 0, at.cast("int")).otherwise(1))
        fits = F.rlike(w, F.lit("^[a-z]+$")) if months == "prefix" else (w == name) | (F.length(w) == 3)
        return F.when((at > 0) & fits, name).otherwise(w)

    return F.transform(words(c), lambda w: let(F.array_position(short, F.substring(w, 1, 3)), lambda at: full(w, at)))


def normalize_keypoint(c: Column, months: str = "prefix") -> Column:
    """The keypoint_words with one space between."""
    return F.array_join(keypoint_words(c, months), " ")


def normalize_match(c: Column) -> Column:
    """Letters, digits, _ and CJK stay; all else becomes one space."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^0-9a-z_\x{4e00}-\x{9fff}]+", " "))


def _mapped(w: Column, table: dict[str, str]) -> Column:
    keys, values = strings(list(table)), strings(list(table.values()))
    at = F.array_position(keys, w)
    return F.when(at > 0, F.element_at(values, F.when(at > 0, at.cast("int")).otherwise(1))).otherwise(w)


def visual_token(w: Column) -> Column:
    """Synonym, else the first suffix rule that fits, then a past tense ending, then synonym again."""
    stop = strings(list(VISUAL_SYNONYMS))

    def stemmed(w: Column) -> Column:
        stem = w
        for suffix, to in reversed(SUFFIX_RULES):
            fits = (F.length(w) > 4) & F.endswith(w, F.lit(suffix)) & (F.length(w) - len(suffix) + len(to) >= 3)
            stem = F.when(fits, F.concat(F.substr(w, F.lit(1), F.length(w) - len(suffix)), F.lit(to))).otherwise(stem)
        return stem

    def present(v: Column) -> Column:
        ends = lambda e: (F.length(v) > 4) & F.endswith(v, F.lit(e)) & (F.length(v) - len(e) >= 3)
        return F.when(ends("ed"), F.substr(v, F.lit(1), F.length(v) - 2)).when(ends("d"), F.substr(v, F.lit(1), F.length(v) - 1)).otherwise(v)

    mapped = lambda v: _mapped(v, VISUAL_SYNONYMS)
    return let(F.lower(w), lambda x: F.when(F.array_contains(stop, x), mapped(x)).otherwise(let(let(let(x, stemmed), present), mapped)))


def visual_tokens(c: Column) -> Column:
    """Normalised words of three letters or more that aren't stop words, before and after."""
    stop = strings(VISUAL_STOPWORDS)
    raw = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))
    return F.filter(F.transform(raw, visual_token), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))


def query_keywords(c: Column, most: int = 8) -> Column:
    """Distinct words of three letters or more, of any alphabet, without stop words; else the query's first 64 characters."""
    stop = strings(KEYWORD_STOPWORDS)
    bare = F.transform(words(c), lambda w: F.lower(F.regexp_replace(w, r"""^[ ,.;:!?()\[\]{}"'\n\t]+|[ ,.;:!?()\[\]{}"'\n\t]+$""", "")))
    kept = F.array_distinct(F.filter(bare, lambda w: F.rlike(w, F.lit(r"^\p{L}{3,}$")) & ~F.array_contains(stop, w)))
    return F.when(F.size(kept) > 0, F.slice(kept, 1, most)).otherwise(F.array(F.substring(c, 1, 64)))


def query_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9\x{4e00}-\x{9fa5}]+"), lambda w: F.length(w) >= 3))


def cut_at_word(c: Column, most: int) -> Column:
    """At most `most` characters, no broken word at the end, no trailing separators."""
    short = F.substring(c, 1, most)
    whole = F.regexp_replace(F.regexp_replace(short, "[A-Za-z0-9]+$", ""), r"[; ,]+$", "")
    return F.when(F.length(c) <= most, c).otherwise(whole)


def cut_field(c: Column, most: int = 280) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def without_words(c: Column, unwanted=SPECULATION) -> Column:
    """The text without tokens that are exactly one of `unwanted`; as it is where it holds none of them in any word."""
    holds = reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(w)) for w in unwanted))
    return F.when(holds, F.array_join(F.filter(words(c), lambda w: ~F.array_contains(strings(unwanted), F.lower(w))), " ")).otherwise(strip(c))


def distinct_sentences(c: Column) -> Column:
    """Sentences that differ in more than case, in order of first mention."""
    parts = F.filter(F.transform(F.split(c, r"[.!?]+"), strip), lambda p: p != "")
    lower = F.transform(parts, F.lower)
    return F.filter(parts, lambda p, i: F.array_position(lower, F.lower(p)) == i + 1)


def fallback_caption(caption: Column, source: Column, least: int = 20) -> Column:
    joined = F.concat(F.array_join(distinct_sentences(source), ". "), F.lit("."))
    return F.when(F.length(F.coalesce(caption, F.lit(""))) < least, joined).otherwise(caption)


def token_count(c: Column) -> Column:
    """White-space tokens; the offline default where no tokenizer is plugged in."""
    return F.size(words(F.coalesce(c, F.lit(""))))


def model_tag(c: Column, api: Column | None = None) -> Column:
    """The short name of a model: by the part that the API's model name contains, else by that of its own name,
    else what stands before the first colon."""
    bare = F.substring_index(F.lower(F.coalesce(c, F.lit(""))), ":", 1)
    out = F.regexp_replace(F.when(bare == "", "misc").otherwise(bare), "/", "_")
    for part, tag in reversed(MODEL_TAGS):
        out = F.when(F.contains(F.lower(c), F.lit(part)), tag).otherwise(out)
    for tag in reversed(API_TAGS if api is not None else ()):
        out = F.when(F.contains(F.lower(api), F.lit(tag)), tag).otherwise(out)
    return out


def provider(c: Column, default: str = "chatgpt") -> Column:
    """One of chatgpt, gemini, claude; unknown names are chatgpt, none at all is the default."""
    name = F.lower(F.when(F.coalesce(c, F.lit("")) == "", F.lit(default)).otherwise(c))
    return F.coalesce(F.get(F.transform(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in PROVIDERS.items())), lambda x: x["k"] == name), lambda x: x["v"]), F.lit(0)), F.lit("chatgpt"))
