"""Scalar text functions of the retrieval engine, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(s: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(s), F.lit("([a-z0-9]+)"), 1)


def title_of(text: Column) -> Column:
    """The first line, of 80 characters at most."""
    return F.substring(F.substring_index(text, "\n", 1), 1, 80)


def processed(s: Column) -> Column:
    """Lower-cased, with everything but letters and digits as spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]", " "))


def trigrams(s: Column) -> Column:
    """The set of three-character pieces of s, padded by two spaces before and one behind."""
    c = F.split(F.concat(F.lit("  "), s, F.lit(" ")), "")
    n = F.greatest(F.char_length(s) + 1, F.lit(0))
    # columns zipped outside the lambda: what stands inside one is worked out again for each piece
    zipped = F.arrays_zip(*[F.slice(c, F.lit(i + 1), n).alias(f"c{i}") for i in range(3)])
    return F.array_distinct(F.transform(zipped, lambda z: F.concat(z["c0"], z["c1"], z["c2"])))


#: What opens or closes a block of code (fixed value).
FENCE = r"```\w*"


def unfenced(md: Column) -> Column:
    """Without fence markers and the languages they name."""
    return F.regexp_replace(md, FENCE, " ")


def plain(md: Column) -> Column:
    """Markdown without fence markers, backticks and #, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(unfenced(md), r"[`#]", " "), r"\s+", " "))


def clean(s: Column) -> Column:
    """Without control characters (tab and newline stay) and direction overrides."""
    return F.regexp_replace(s, "[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F\\u202A-\\u202E\\u2066-\\u2069]", "")


def api_name(title: Column) -> Column:
    """Without a final " (kind)"."""
    return F.regexp_replace(title, r"\s+\([^)]*\)$", "")


#: Short names of packages as queries write them (fixed values).
ALIASES = {"np": "numpy", "pd": "pandas", "plt": "matplotlib.pyplot", "sp": "scipy", "tf": "tensorflow", "nn": "torch.nn", "F": "torch.nn.functional", "sk": "sklearn"}
#: What a name loses on the way to its key, in order (fixed values): a receiver in brackets, four
#: times type arguments, sigils, a call's empty brackets; then the space around an operator in brackets.
RECEIVER, TYPE_ARGUMENTS, SIGILS, CALL = r"^\((?:\w+\s+)?\*?(\w+)\)\.", r"(?<=\w)(<[\w\s,:&*'\[\]]*>|\[[\w\s,:&*']+\])", r"^[&*@#]+(?=\w)", r"(?<!operator)\(\)$"
BRACKETED = r"\(\s*([^\w\s()]+)\s*\)"


def name_key(q: Column) -> Column:
    """How names are compared, whatever language writes them; null if nothing is left."""
    out = F.regexp_replace(F.trim(q), RECEIVER, "$1.")
    for _ in range(4):
        out = F.regexp_replace(out, TYPE_ARGUMENTS, "")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, SIGILS, ""), CALL, ""), BRACKETED, "($1)")
    out = F.replace(F.regexp_replace(F.lower(out), r"\s+", "_"), F.lit("::"), F.lit("."))

    def expanded(key: Column) -> Column:
        first = F.substring_index(key, ".", 1)
        full = F.element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), first)
        whole = F.concat(full, F.substr(key, F.char_length(first) + 1, F.char_length(key)))
        return F.when(F.contains(key, F.lit(".")) & full.isNotNull(), whole).when(key != "", key)

    # an array of one, so that the key is worked out once and not wherever it is named
    return F.get(F.transform(F.array(out), expanded), F.lit(0))


def api_keys(title: Column) -> Column:
    """The keys an API name is found by: every dotted suffix (parts may be joined by ::), without a
    last !, and with white space as _ too."""
    name = F.replace(F.lower(api_name(title)), F.lit("::"), F.lit("."))
    own = suffixes(name)
    bang = F.transform(F.filter(own, lambda k: F.endswith(k, F.lit("!"))), lambda k: F.regexp_replace(k, "!$", ""))
    spaced = F.transform(F.filter(own, lambda k: F.contains(k, F.lit(" "))), lambda k: F.regexp_replace(k, r"\s+", "_"))
    return F.array_distinct(F.concat(own, bang, spaced))


def suffixes(key: Column) -> Column:
    """Every dotted suffix of a name, itself included."""
    parts = F.split(key, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def dots(s: Column) -> Column:
    return F.char_length(s) - F.char_length(F.replace(s, F.lit("."), F.lit("")))


def summary(text: Column) -> Column:
    """The first line over three characters that is no table row and ends in no colon, fences removed; of 200 characters."""
    lines = F.transform(F.split(F.regexp_replace(text, r"(?s)```.*?(```|\z)", ""), "\n"), lambda x: F.trim(x))
    good = F.filter(lines, lambda x: (F.char_length(x) > 3) & ~F.startswith(x, F.lit("|")) & ~F.endswith(x, F.lit(":")))
    return F.substring(F.coalesce(F.get(good, F.lit(0)), F.lit("")), 1, 200)


def snippet(text: Column, query: Column, width: int = 170, sentences: int = 300) -> Column:
    """The sentence of the plain text with most distinct query tokens, the earliest of equals; of a
    longer one, width characters from a third of that before the first token found in it."""
    wanted = F.array_distinct(tokens(query))
    every = F.filter(F.transform(F.slice(F.split(plain(text), r"(?<=[.!?])\s+"), 1, sentences), lambda s: F.trim(s)), lambda s: s != "")
    scored = F.transform(every, lambda s, i: F.struct((-F.size(F.array_intersect(tokens(s), wanted))).alias("n"), i.alias("i"), s.alias("s")))
    best = F.coalesce(F.array_min(scored)["s"], F.lit(""))
    found = F.array_min(F.filter(F.transform(wanted, lambda t: F.instr(F.lower(best), t)), lambda at: at > 0))
    start = F.greatest(F.lit(0), F.coalesce(found - 1 - width // 3, F.lit(0)))
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.trim(F.substr(best, start + 1, F.lit(width))), F.lit("…"))
    return F.when(F.char_length(best) <= width, best).otherwise(cut)


def natural_key(s: Column) -> Column:
    """Sorts runs of digits by value and the rest as text."""
    number = lambda t: F.regexp_like(t, F.lit("^[0-9]"))
    return F.transform(F.regexp_extract_all(s, F.lit(r"(\d+|\D+)"), 1), lambda t: F.struct(F.when(number(t), 0).otherwise(1).alias("kind"), F.when(number(t), F.substring(t, 1, 18).cast("long")).otherwise(0).alias("n"), t.alias("t")))


def shingles(words: Column, n: int = 4) -> Column:
    """The set of runs of n words."""
    count = F.greatest(F.lit(0), F.size(words) - n + 1)
    # slices outside the lambda: one inside it would work out the words again for each run
    columns = F.arrays_zip(*[F.slice(words, F.lit(i + 1), count).alias(f"w{i}") for i in range(n)])
    return F.array_distinct(F.transform(columns, lambda z: F.concat_ws(" ", *[z[f"w{i}"] for i in range(n)])))


def normal_url(url: Column) -> Column:
    """Without query, fragment, scheme, www and a trailing slash or index page; host lower-cased."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z]+://(www\.)?", "")
    host = F.lower(F.regexp_extract(bare, "^([^/]*)", 1))
    return F.concat(host, F.regexp_replace(F.regexp_replace(bare, "^[^/]*", ""), r"(/index)?(\.html?)?/?$", ""))


def page_url(url: Column) -> Column:
    """One address for a page: no query, no fragment and no @go version of a module."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"@go[\d.]+(?=$|/)", "")


def rel_of(url: Column, root: Column) -> Column:
    """A page's place under a root, index.html for the root itself; null outside it."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    rest = F.regexp_replace(F.substr(bare, F.char_length(root) + 1, F.char_length(bare)), "^/+|/+$", "")
    return F.when((root != "") & F.startswith(bare, root), F.when(rest == "", "index.html").otherwise(rest))


def below(parent: Column, child: Column) -> Column:
    """Whether a page lies in the folder that another one introduces: an index page its own folder,
    another page the folder of its name."""
    last = F.substring_index(parent, "/", -1)
    folder = F.when(F.endswith(parent, F.lit("index.html")), F.regexp_replace(parent, "index\\.html$", "")).when(~F.contains(last, F.lit(".")), F.concat(parent, F.lit("/"))).otherwise(F.concat(F.regexp_replace(parent, r"\.[^.]*$", ""), F.lit("/")))
    return (child != parent) & F.startswith(child, folder)


def organization(host: Column) -> Column:
    """Who runs a host: the last two parts of its name."""
    parts = F.split(F.substring_index(F.lower(host), ":", 1), r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), ".")


def moved(url: Column, real: Column, base: Column) -> Column:
    """Where the docs under base went, if url, under it, led to real in the same place of another
    folder of the same organization; null if they didn't move."""
    host = lambda u: F.regexp_extract(u, "^[a-z]+://([^/]*)", 1)
    rest = F.substr(url, F.char_length(base) + 1, F.char_length(url))
    new = F.substr(real, F.lit(1), F.char_length(real) - F.char_length(rest))
    last = F.substring_index(new, "/", -1)
    folder = F.when(F.contains(last, F.lit(".")), F.substr(new, F.lit(1), F.char_length(new) - F.char_length(last))).otherwise(F.concat(new, F.lit("/")))
    new = F.when(F.endswith(base, F.lit("/")) & ~F.endswith(new, F.lit("/")), folder).otherwise(new)
    went = F.startswith(url, base) & ~F.startswith(real, base) & F.endswith(real, rest) & (organization(host(real)) == organization(host(base)))
    return F.when(went & F.startswith(new, F.lit("https://")), new)


def image_name(url: Column) -> Column:
    return F.sha1(url)


def image_type(data: Column) -> Column:
    """What an image is by its first bytes (fixed values); null if it is none."""
    starts = lambda prefix: F.startswith(F.hex(F.substring(data, 1, 12)), F.lit(prefix.hex().upper()))
    head = F.lower(F.ltrim(F.decode(F.substring(data, 1, 1000), "ISO-8859-1")))
    webp = starts(b"RIFF") & (F.hex(F.substring(data, 9, 4)) == b"WEBP".hex().upper())
    svg = F.startswith(head, F.lit("<svg")) | (F.startswith(head, F.lit("<?xml")) & F.contains(head, F.lit("<svg")))
    return F.when(starts(b"\x89PNG\r\n\x1a\n"), "image/png").when(starts(b"\xff\xd8\xff"), "image/jpeg").when(starts(b"GIF87a") | starts(b"GIF89a"), "image/gif").when(webp, "image/webp").when(svg, "image/svg+xml")


def import_line(name: Column, kind: Column) -> Column:
    """The line of Python that imports an API object: a member comes with its class."""
    parts = F.split(name, r"\.")
    member = kind.isin("method", "attribute", "property", "classmethod", "staticmethod") & (F.size(parts) > 2)
    own = F.when(member, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    line = F.concat(F.lit("from "), F.array_join(F.slice(own, F.lit(1), F.size(own) - 1), "."), F.lit(" import "), F.element_at(own, -1))
    return F.when(kind == "module", F.concat(F.lit("import "), name)).when(F.size(parts) > 1, line)


def split_of(text: Column) -> Column:
    """dev for three in ten texts by their SHA-1, else test: the hexadecimal digest modulo ten, digit by digit."""
    digits = F.transform(F.split(F.sha1(text), ""), lambda d: F.conv(d, 16, 10).cast("int"))
    return F.when(F.aggregate(digits, F.lit(0), lambda acc, d: (acc * 16 + d) % 10) < 3, "dev").otherwise("test")


def label_text(text: Column) -> Column:
    """A version as a folder's name carries it."""
    bare = F.regexp_replace(F.trim(text), r"(?i)^v(?=\d)", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"[^\w.-]+", "-"), r"^[-.]+|[-.]+$", ""))


#: Labels of copies that are no release yet (fixed value).
CHANNEL = r"^(?:(nightly|beta|alpha)-\d{4}-\d\d-\d\d|.+-(beta|alpha|draft))$"


def label_of_copy(sid: Column) -> Column:
    """What follows the first @ of a copy's name."""
    return F.when(F.contains(sid, F.lit("@")), F.regexp_replace(sid, "^[^@]*@", "")).otherwise("")


def channel_of(sid: Column) -> Column:
    """nightly, beta, alpha or draft for a copy that is no release; null for one that is."""
    label = label_of_copy(sid)
    return F.nullif(F.concat(F.regexp_extract(label, CHANNEL, 1), F.regexp_extract(label, CHANNEL, 2)), F.lit(""))


def version_key(sid: Column) -> Column:
    """Sorts copies: releases after channels, then by the numbers in their labels."""
    numbers = F.transform(F.regexp_extract_all(label_of_copy(sid), F.lit(r"(\d+)"), 1), lambda x: x.cast("long"))
    return F.struct(channel_of(sid).isNull().alias("release"), numbers.alias("numbers"))
