"""String functions as column expressions: everything here stays in the JVM and in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- white space ---------------------------------------------------------------------------------------------------------------------

#: Unicode white space, as ``str.split`` and ``str.strip`` take it.
SPACE = r"(?U)[\s\x{1C}-\x{1F}\x{85}]+"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, rf"^{SPACE}|{SPACE}$", "")


def fold_space(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def words(c: Column) -> Column:
    """The white-space words of a text; none for null or blank texts."""
    return F.coalesce(F.filter(F.split(c, SPACE), lambda w: w != ""), F.array().cast("array<string>"))


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"(?U)[^\s\x{1C}-\x{1F}\x{85}]+")), F.lit(0))


def dedup_key(c: Column) -> Column:
    """Lower case, white space folded: two texts with one key count as the same."""
    return fold_space(F.lower(c))


def first_text(*candidates: Column) -> Column:
    """The first candidate that isn't null or blank, stripped; else the empty string."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in candidates], F.lit(""))


def first_value(*candidates: Column, default: str = "unk") -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(default))


# --- paths and URLs --------------------------------------------------------------------------------------------------------------------


def folder(path: Column) -> Column:
    """The top folder; null without one."""
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1))


def below_folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"^[^/]*/", ""))


def without_extension(path: Column) -> Column:
    """Up to the last dot of the last segment."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


#: How the folders of speech tokens end (fixed value).
TOKEN_SUFFIX = "_neucodec"


def token_path(path: Column, suffix: str = TOKEN_SUFFIX, extension: str = ".json") -> Column:
    """``folder/rest.ext`` as ``folder<suffix>/rest<extension>``; null without a folder."""
    return F.concat(folder(path), F.lit(f"{suffix}/"), without_extension(below_folder(path)), F.lit(extension))


def token_path_styled(path: Column, style: Column, suffixes: dict[str, str]) -> Column:
    """``token_path`` with the suffix of the row's style."""
    out = F.lit(None).cast("string")
    for name, suffix in suffixes.items():
        out = F.when(style == name, token_path(path, suffix)).otherwise(out)
    return out


def replace_everywhere(path: Column, old: str, new: str) -> Column:
    """Every occurrence, not the suffix alone."""
    return F.replace(path, F.lit(old), F.lit(new))


def path_part(path: Column, index: int, least: int) -> Column:
    """Segment ``index`` from 0 where there are more than ``least``; else null."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > least, F.get(parts, F.lit(index)))


def path_language(path: Column) -> Column:
    return path_part(path, 1, 2)


def path_split(path: Column) -> Column:
    return path_part(path, 2, 3)


def rebase(path: Column, root: str) -> Column:
    """Another top folder."""
    return F.concat(F.lit(f"{root}/"), below_folder(path))


def archive_member(path: Column, ending: str = "_trim", extension: str = ".mp3") -> tuple[Column, Column]:
    """(archive, member) of an audio path's tokens: the first folder that ends so names the archive, what is below it the member; null for other files."""
    pattern = rf"^(?:[^/]*/)*?([^/]*{ending})/(.*)\{extension}$"
    top = F.concat(F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")), F.lit(TOKEN_SUFFIX))
    return F.concat(top, F.lit(".zip")), F.concat(top, F.lit("/"), F.regexp_extract(path, pattern, 2), F.lit(".json"))


def name_and_split(stem: Column) -> tuple[Column, Column]:
    """``a-b-train`` as (``a-b``, ``train``)."""
    pattern = r"^(.*)-([^-]*)$"
    return F.regexp_extract(stem, pattern, 1), F.regexp_extract(stem, pattern, 2)


def shard_base(stem: Column) -> Column:
    """A shard's stem without ``-<number>-<number>``."""
    return F.regexp_replace(stem, r"-\d+-\d+$", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_key(path: Column, size: int = 16) -> Column:
    """A name for a path's side file that no two paths share."""
    return F.substring(F.sha1(path), 1, size)


def short_name(run: Column, prefix: str, constants: tuple[str, ...] = ("-wd0.01", "lr0.001-"), spaced: tuple[str, ...] = ("mlr", "lr")) -> Column:
    """A run's name without the prefix, the separator after it and the parts that all runs share; a space follows each of ``spaced``, in order."""
    out = F.when(F.startswith(run, F.lit(prefix)), F.substring(run, len(prefix) + 2, 1_000_000_000)).otherwise(run)
    for old, new in [*((c, "") for c in constants), *((c, c + " ") for c in spaced)]:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def url_parts(url: Column) -> dict[str, Column]:
    """scheme, host, path, query, fragment and the first path segment; null where missing."""
    pattern = r"^(?:([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    part = lambda k: F.nullif(F.regexp_extract(url, pattern, k), F.lit(""))
    names = ("scheme", "host", "path", "query", "fragment")
    out = {n: part(i) for i, n in enumerate(names, 1)}
    return out | {"section": F.nullif(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?/([^/?#]+)", 1), F.lit(""))}


# --- labels ------------------------------------------------------------------------------------------------------------------------------

#: Language codes that models confuse, by macro-language (fixed values).
MACRO_LANGUAGES = {
    "ara": ("arb", "ars", "arz", "acm", "acq", "aeb", "afb", "ajp", "apc", "apd", "ary", "ayn", "ayp"),
    "fas": ("pes", "prs"),
    "hbs": ("bos", "cnr", "hrv", "srp"),
    "msa": ("bjn", "ind", "min", "zsm"),
    "nor": ("nno", "nob"),
    "pus": ("pbt", "pst"),
    "swa": ("swc", "swh"),
    "uzb": ("uzn", "uzs"),
}


def lookup(c: Column, table: dict[str, str]) -> Column:
    """A small literal table's value; null for other keys."""
    flat = [F.lit(x) for pair in table.items() for x in pair]
    return F.element_at(F.create_map(*flat), c)


def macro_language(code: Column) -> Column:
    return F.coalesce(lookup(code, {m: g for g, ms in MACRO_LANGUAGES.items() for m in ms}), code)


def label_parts(label: Column) -> tuple[Column, Column, Column]:
    """(label, language, script) of ``__label__xxx_Script``, split at the last underscore."""
    bare = F.replace(label, F.lit("__label__"), F.lit(""))
    return bare, F.regexp_replace(bare, "_[^_]*$", ""), F.regexp_extract(bare, "_([^_]*)$", 1)


def language_base(code: Column) -> Column:
    return F.substring_index(code, "-", 1)


def clean_markers(c: Column) -> Column:
    """A transcript as one line, without ``<...>`` and ``[...]`` marks of up to 20 characters."""
    return fold_space(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]{0,20}>", " "), r"\[[^\]]{0,20}\]", " "))


def has_letter(c: Column) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit(r"\p{L}")), F.lit(False))


# --- scripts and characters ----------------------------------------------------------------------------------------------------------------

#: Code points of scripts that the predicates below look for (fixed values).
INDIC = r"\x{0900}-\x{0D7F}"
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}"
CYRILLIC = r"\x{0400}-\x{04FF}"
ARABIC = r"\x{0600}-\x{06FF}"
#: Scripts that write without spaces.
UNSPACED = r"\x{0E00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}"
#: Characters that are words of their own.
SINGLE = r"\x{1100}-\x{11FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{20000}-\x{2A6DF}"


def has_any(c: Column, ranges: str) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit(f"[{ranges}]")), F.lit(False))


def has_indic(c: Column) -> Column:
    return has_any(c, INDIC)


def has_han(c: Column) -> Column:
    return has_any(c, HAN)


def has_cyrillic(c: Column) -> Column:
    return has_any(c, CYRILLIC)


def has_arabic(c: Column) -> Column:
    return has_any(c, ARABIC)


def strip_speech_marks(c: Column) -> Column:
    """Without bracketed notes, punctuation and symbols; white space folded."""
    out = c
    for pattern in (r"\[[^\]]*\]", r"\([^)]*\)", "（[^）]*）", r"[\p{P}\p{S}]"):
        out = F.regexp_replace(out, pattern, "")
    return fold_space(out)


def mixed_words(c: Column) -> Column:
    """Words of mixed scripts: characters of unspaced East Asian scripts and Hangul one by one, others by white space."""
    return F.regexp_extract_all(c, F.lit(rf"(?U)[{SINGLE}]|[^\s\x{{1C}}-\x{{1F}}\x{{85}}{SINGLE}]+"), F.lit(0))


#: Character types by code points (fixed values).
CHARACTER_TYPES = {
    "arabic": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}",
    "chinese": r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{2A6DF}",
    "cyrillic": r"\x{0400}-\x{04FF}",
    "devanagari": r"\x{0900}-\x{097F}",
    "latin": r"\x{0021}-\x{007E}\x{00A1}-\x{00AC}\x{00AE}-\x{024F}",
    "tamil": r"\x{0B80}-\x{0BFF}",
}
KANA = r"\x{3040}-\x{30FF}"
HANGUL = r"\x{1100}-\x{11FF}\x{AC00}-\x{D7AF}"


def character_type(c: Column) -> Column:
    """The commonest type of a text's characters; any kana makes it Japanese, else any Hangul Korean; of equals the one met first, ideographs last, none is "other"."""
    first = lambda name, r: F.lit(2**31 - 1) if name == "chinese" else F.regexp_instr(c, F.lit(f"[{r}]"))
    counted = F.array(*[F.struct((-F.regexp_count(c, F.lit(f"[{r}]"))).alias("n"), first(name, r).alias("at"), F.lit(name).alias("name")) for name, r in CHARACTER_TYPES.items()])
    top = F.array_min(counted)
    return F.when(has_any(c, KANA), "japanese").when(has_any(c, HANGUL), "korean").when(top["n"] < 0, top["name"]).otherwise("other")


# --- n-grams and distances ---------------------------------------------------------------------------------------------------------------------


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens, each joined by a space."""

    def runs(t):
        last = F.size(t) - (n - 1)
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(tokens, runs)


def most_repeated(items: Column) -> Column:
    """How often the commonest item of an array occurs; runs of the sorted array, so no explode and no shuffle."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s, x):
        run = F.when(s["last"].eqNullSafe(x), s["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(F.array_sort(items), start, step, lambda s: s["best"])


def error_rate(reference: Column, hypothesis: Column, clip: bool = False) -> Column:
    """Character error rate: edits per reference character; an empty reference gives 0 for an empty hypothesis, else 1."""
    n = F.length(reference)
    rate = F.when(n == 0, F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(reference, hypothesis) / n)
    return F.least(rate, F.lit(1.0)) if clip else rate


# --- tags -----------------------------------------------------------------------------------------------------------------------------------------

TAG = r"<\|sfx:([a-z_]+)\|>"


def tags(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TAG), F.lit(1))


def without_tags(c: Column) -> Column:
    return F.lower(fold_space(F.regexp_replace(c, TAG, " ")))


#: What vocal events sound like, and in scripts of their own (fixed values).
SOUNDS = {"burping": "Burp", "cough": "Ahem", "crying": "Huhu", "humming": "Hmm", "laughter": "Haha", "screaming": "Ahh", "sigh": "Hah", "sneeze": "Achoo", "sniff": "Sff"}
SOUNDS_BY_LANGUAGE = {
    "ta": {"cough": "அஹம்", "crying": "ஊஊ", "laughter": "ஹஹ", "screaming": "ஆஹ்", "sigh": "ஆ", "sneeze": "அச்சூ"},
    "zh": {"burping": "嗝", "cough": "咳咳", "crying": "呜呜", "humming": "嗯", "laughter": "哈哈", "screaming": "啊", "sigh": "唉", "sneeze": "阿嚏", "sniff": "哼"},
}
LONG_LAUGH_SECONDS = 1.2


def sound(family: Column, language: Column, seconds: Column) -> Column:
    """The onomatopoeia of an event, in the language's script where there is one; a long laugh goes on."""
    own = lookup(F.concat_ws("/", language, family), {f"{g}/{f}": s for g, fs in SOUNDS_BY_LANGUAGE.items() for f, s in fs.items()})
    plain = F.coalesce(own, lookup(family, SOUNDS))
    longer = F.when(language.isin(*SOUNDS_BY_LANGUAGE), F.concat(plain, F.substring(plain, 2, 9)))
    return F.when((family == "laughter") & (seconds > LONG_LAUGH_SECONDS), F.coalesce(longer, F.lit("Hahaha"))).otherwise(plain)


# --- prompts and punctuation ---------------------------------------------------------------------------------------------------------------------

#: Replacements in their order, and marks that end a prompt (fixed values).
PROMPT_MARKS = (("...", ", "), ("…", ", "), (":", ","), (" - ", ", "), (";", ", "), ("—", "-"), ("–", "-"), (" ,", ","), ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"))
PROMPT_ENDS = r"[.!?,、，。？！-]$"
EMPTY_PROMPT = "You need to add some text for me to talk."


def prompt_punctuation(c: Column) -> Column:
    """A prompt for speech: capital first, white space folded, rare marks replaced in order, an end mark."""
    out = fold_space(F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1_000_000_000)))
    for old, new in PROMPT_MARKS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.rtrim(out)
    out = F.when(F.regexp_like(out, F.lit(PROMPT_ENDS)), out).otherwise(F.concat(out, F.lit(".")))
    return F.when(F.length(c) == 0, EMPTY_PROMPT).otherwise(out)


# --- symbols that SQL can strip alone ------------------------------------------------------------------------------------------------------------


def drop_loose_marks(c: Column) -> Column:
    """Without ``%`` and ``$`` that no digit touches."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)(?<!\d)%(?!\d)", ""), r"(?U)(?<!\d)\$(?!\d)", "")


def drop_empty_brackets(c: Column) -> Column:
    """Bracket groups without a word as a space."""
    return F.regexp_replace(c, r"(?U)[<\[({「『【（][\W_]*?[>\])}」』】）]", " ")


def tidy_space(c: Column) -> Column:
    """White space folded, none before marks, none around a hyphen between digits."""
    out = F.regexp_replace(c, r"(?U)(\d)\s*-\s*(\d)", "$1-$2")
    return fold_space(F.regexp_replace(out, r"(?U)\s+([,.;:!?。，、？！；：])", "$1"))


def collapse_marks(c: Column) -> Column:
    """A run of one mark as one; exactly two dots as one."""
    return F.regexp_replace(F.regexp_replace(c, r"([!?。！？，、,])\1+", "$1"), r"(?<!\.)\.\.(?!\.)", ".")


def language_prompt(c: Column, language: Column, space: str = "[SPACE]") -> Column:
    """``[xx]`` before a text where its language is known, and a mark of its own for each space: what a tokenizer of many languages is given."""
    told = F.when(F.coalesce(language, F.lit("")) != "", F.concat(F.lit("["), F.lower(language), F.lit("]"), c)).otherwise(c)
    return F.replace(told, F.lit(" "), F.lit(space))
