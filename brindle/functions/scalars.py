"""Scalar functions as column expressions: all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = "[一-鿿㐀-䶿豈-﫿]"
CJK = "[一-鿿㐀-䶿豈-﫿぀-ヿ가-힯]"
#: What optical reading counts as CJK: ideographs, kana, syllables, CJK punctuation and full-width forms; brackets that open and close (fixed values).
WIDE = r"\u4E00-\u9FFF\u3040-\u30FF\uAC00-\uD7AF\u3000-\u303F\uFF00-\uFFEF"
WIDE_OPEN, WIDE_CLOSE = r"\uFF08\u300A\u300C\u3010", r"\uFF09\u300B\u300D\u3011"
#: What Chinese reading models write for a blank (fixed value).
FILLER = "极"
#: Hosts of the machine itself (fixed values).
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1")
#: File kinds by extension (fixed values).
FILE_KINDS = {
    "markdown": ("md", "markdown", "mdown"),
    "text": ("txt",),
    "pdf": ("pdf",),
    "docx": ("docx",),
    "code": ("go", "py", "rs", "ts", "tsx", "js", "jsx", "java", "c", "cpp", "h", "hpp", "rb", "php", "sh", "bash", "swift", "kt", "scala"),
    "json": ("json",),
    "yaml": ("yaml", "yml"),
    "html": ("html", "htm", "xhtml"),
}
#: Brands of boxed image files (fixed values).
AVIF_BRANDS = ("avif", "avis")
HEIC_BRANDS = ("heic", "heix", "hevc", "hevx", "mif1", "msf1")
#: Words that lower or raise a score read from an answer (fixed values).
AI_WORDS = ("ai-generated", "likely ai", "artificial", "synthetic", "deepfake", "generated")
HUMAN_WORDS = ("human-made", "real photo", "natural", "authentic", "realistic")
#: What parts words: Unicode's blanks and line ends (in a character class).
SPACES = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value), with value computed once even if lambdas in use refer to it."""
    return F.transform(F.array(value), use)[0]


TOKEN = r"[\p{L}\p{Nd}]+"


def tokenize(text) -> Column:
    """Lower-cased runs of letters and digits; a run of more than two CJK characters becomes its overlapping pairs."""
    runs = F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN), F.lit(0))
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))
    # most texts have no CJK characters and take no second look at their runs
    cut = F.flatten(F.transform(runs, lambda t: F.when((F.length(t) > 2) & t.rlike(f"^{CJK}+$"), pairs(t)).otherwise(F.array(t))))
    return F.when(col(text).rlike(CJK), cut).otherwise(runs)


def token_count(text) -> Column:
    """size(tokenize(text)), without an array for most texts; 0 for null."""
    n = F.when(col(text).rlike(CJK), F.size(tokenize(text))).otherwise(F.regexp_count(F.lower(col(text)), F.lit(TOKEN)))
    return F.coalesce(n, F.lit(0))


def words(text) -> Column:
    """Lower-cased runs of letters, digits, ' and -."""
    return F.regexp_extract_all(F.lower(F.trim(col(text))), F.lit(r"[\p{L}\p{Nd}'-]+"), F.lit(0))


def embedding_ngrams(text) -> Column:
    """Distinct n-grams for hashing, in order of appearance: words of more than two bytes and the pairs that they start; characters, pairs and triples if most are CJK."""
    none = F.array().cast("array<string>")

    def latin(w):
        at = lambda i: F.element_at(w, i)
        each = lambda i: F.when(F.octet_length(at(i)) <= 2, none).when(i < F.size(w), F.array(at(i), F.concat(at(i), F.lit(" "), at(i + 1)))).otherwise(F.array(at(i)))
        return F.when(F.size(w) == 0, none).otherwise(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), each))))

    def cjk(t):
        part = lambda i, k: F.when(i + k - 1 <= F.length(t), F.array(F.substr(t, i, F.lit(k)))).otherwise(none)
        each = lambda i: F.when(F.substr(t, i, F.lit(1)).rlike(r"^[\s\p{P}]?$"), none).otherwise(F.concat(part(i, 1), part(i, 2), part(i, 3)))
        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), each)))

    t = F.lower(F.trim(col(text)))
    n_cjk = F.length(t) - F.length(F.regexp_replace(t, CJK, ""))
    return F.when(n_cjk > F.floor(F.length(t) / 2), let(t, cjk)).otherwise(let(words(text), latin))


def checksum(text) -> Column:
    return F.sha2(col(text).cast("binary"), 256)


def content_hash(*cols) -> Column:
    """MD5 of the JSON of the columns, with keys in order and a blank after each colon and comma."""
    value = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)
    return F.md5(F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{c}": '), value(c)) for c in sorted(cols))), F.lit("}")))


#: White space of any script, and what counts as a letter, digit or underscore.
BLANK = r"\s\x1C-\x1F\x85\p{Z}"
WORD = r"\p{L}\p{N}_"


def text_key(text) -> Column:
    """Lower-cased and stripped; then without all but letters, digits, _ and blanks, and each run of blanks one blank; the first 200 characters. Blanks that punctuation set apart at the ends stay."""
    t = F.regexp_replace(F.lower(col(text)), f"^[{BLANK}]+|[{BLANK}]+$", "")
    t = F.regexp_replace(t, f"[^{WORD}{BLANK}]", "")
    return F.substring(F.regexp_replace(t, f"[{BLANK}]+", " "), 1, 200)


def slugify(text) -> Column:
    """ASCII letters in lower case, digits, and a dash for each run of blanks, dashes and underscores; all else goes, so blanks on both sides of what goes are one dash."""
    # only ASCII is left when it is put in lower case
    return F.regexp_replace(F.lower(F.regexp_replace(col(text), "[^A-Za-z0-9 _-]+", "")), "[ _-]+", "-")


def file_slug(title, most: int = 60) -> Column:
    """The slug of a title as a file name holds it: at most 60 characters, untitled for none."""
    # a slug that is named twice is made twice
    return F.regexp_replace(F.substring(F.coalesce(slugify(title), F.lit("")), 1, most), "^$", "untitled")


def project_dir(name) -> Column:
    return F.regexp_replace(col(name), "[^A-Za-z0-9._-]", "_")


def git_project_id(url) -> Column:
    t = F.regexp_replace(F.trim(col(url)), r"\.git/?$", "")
    t = F.regexp_replace(t, r"^git@([^:]+):", "$1/")
    return F.regexp_replace(t, r"^[a-z+]+://(?:[^@/]*@)?", "")


def host(url) -> Column:
    """Host and port of a URL as they are written, without a user; '' if it has none."""
    return F.regexp_extract(col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#]*)", 1)


def hostname(url) -> Column:
    """The host without its port, in lower case."""
    return F.lower(F.regexp_extract(host(url), r"^(\[[^\]]*\]|[^:]*)", 1))


def display_source(url, path) -> Column:
    return F.when(host(url) != "", host(url)).when(col(url) != "", col(url)).when(col(path) != "", "file").otherwise("-")


def url_basename(url) -> Column:
    """What follows the last slash of a URL's path, without parameters, query and fragment; '' for a host alone."""
    path = F.regexp_replace(col(url), r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?|[?#].*$", "")
    return F.regexp_replace(F.substring_index(path, "/", -1), "(?s);.*$", "")


def url_ext(url, default: str = "jpg") -> Column:
    e = F.lower(F.regexp_extract(url_basename(url), r"\.([A-Za-z0-9]{1,5})$", 1))
    return F.when(e == "", default).otherwise(e)


def file_kind(ext) -> Column:
    e = F.lower(col(ext))
    return reduce(lambda c, kv: c.when(e.isin(*kv[1]), kv[0]), FILE_KINDS.items(), F.when(F.lit(False), "")).otherwise("unknown")


def sniff_media(content) -> Column:
    """Kind of an image by its first bytes, '' for others; boxed files go by their brand, and other brands than those known are heif."""
    h = F.hex(F.substring(col(content), 1, 12))
    brand = F.decode(F.substring(col(content), 9, 4), "ISO-8859-1")
    boxed = (F.substring(h, 9, 8) == "66747970") & (F.length(h) == 24)
    starts = lambda *magic: reduce(lambda a, m: a | h.startswith(m), magic, F.lit(False))
    return (
        F.when(starts("FFD8FF"), "jpg").when(starts("89504E470D0A1A0A"), "png").when(starts("474946383761", "474946383961"), "gif").when(starts("424D"), "bmp")
        .when(starts("52494646") & (brand == "WEBP"), "webp")
        .when(boxed, F.when(brand.isin(*AVIF_BRANDS), "avif").when(brand.isin(*HEIC_BRANDS), "heic").otherwise("heif"))
        .when(starts("FF0A"), "jxl").otherwise("")
    )


def first_paragraph(text) -> Column:
    """All of up to 300 bytes; else up to the first line break if it comes after 50 bytes of them, else up to the last sentence end after 50, else as many whole characters as 300 bytes hold, with dots."""
    t = F.regexp_replace(col(text), r"^[\s\p{Z}\x85]+|[\s\p{Z}\x85]+$", "")
    b = F.encode(t, "UTF-8")
    head = F.decode(F.substring(b, 1, 300), "ISO-8859-1")  # a character a byte
    nl = F.locate("\n", head) - 1
    dot = F.length(F.regexp_extract(head, r"(?s)^(.*)\. ", 1))
    inside = F.hex(F.substring(b, 301, 1)).between("80", "BF")
    whole = F.when(inside, F.regexp_replace(head, r"[\xC0-\xFF][\x80-\xBF]*$", "")).otherwise(head)
    upto = lambda n: F.decode(F.substr(b, F.lit(1), n), "UTF-8")
    return F.when(F.octet_length(b) <= 300, t).when(nl > 50, upto(nl)).when(dot > 50, upto(dot + 1)).otherwise(F.concat(F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8"), F.lit("...")))


def word_count(text) -> Column:
    return F.size(F.regexp_extract_all(col(text), F.lit(r"[^\s\p{P}]+"), F.lit(0)))


def count_tokens(text) -> Column:
    return F.ceil(F.length(col(text)) / 4)


def human_size(n) -> Column:
    n = col(n)
    part = lambda p, unit: F.format_string("%.2f " + unit, n / float(1024**p))
    return F.when(n >= 1024**3, part(3, "GB")).when(n >= 1024**2, part(2, "MB")).when(n >= 1024, part(1, "KB")).otherwise(F.concat(n.cast("long").cast("string"), F.lit(" B")))


def camel_to_words(s) -> Column:
    """A blank before each ASCII capital but the first character."""
    return F.regexp_replace(col(s), r"(?s)(?<=.)(?=[A-Z])", " ")


def truncate_meta(s, most: int = 160) -> Column:
    """Runs of blanks squeezed to one and none at the ends; of more than 160 bytes the characters that lie in them whole, and dots."""
    t = F.regexp_replace(F.regexp_replace(col(s), f"^[{BLANK}]+|[{BLANK}]+$", ""), f"[{BLANK}]+", " ")
    head = F.decode(F.substring(F.encode(t, "UTF-8"), 1, most), "ISO-8859-1")  # a character a byte
    inside = F.hex(F.substring(F.encode(t, "UTF-8"), most + 1, 1)).between("80", "BF")
    whole = F.when(inside, F.regexp_replace(head, r"[\xC0-\xFF][\x80-\xBF]*$", "")).otherwise(head)
    return F.when(F.octet_length(t) > most, F.concat(F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8"), F.lit("…"))).otherwise(t)


def has_control_chars(s) -> Column:
    """Has one of the characters 1 to 31."""
    return col(s).rlike(r"[\x01-\x1F]")


def decode_base64_any(s) -> Column:
    """Base 64 with or without white space and padding; null if it is none."""
    t = F.rtrim(F.regexp_replace(col(s), r"\s+", ""), F.lit("="))
    return F.try_to_binary(F.rpad(t, (F.ceil(F.length(t) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64"))


#: The unit of a price without one (fixed value).
PRICE_UNIT = "/次"


def format_price(price, unit) -> Column:
    """The price with its unit, a dash without a price."""
    own = F.when(F.coalesce(col(unit), F.lit("")) == "", PRICE_UNIT).otherwise(col(unit))
    return F.when(col(price).isNull(), "—").otherwise(F.concat(F.format_string("$%.4f", col(price)), own))


def format_discount(rate) -> Column:
    """What a rate leaves to one, in whole per cent."""
    return F.format_string("%.0f%%", (1 - col(rate)) * 100)


def score_level(rate) -> Column:
    r = col(rate)
    return F.when(r >= 0.9, 4).when(r >= 0.65, 3).when(r >= 0.4, 2).when(r >= 0.2, 1).otherwise(0)


#: Marks and words of the levels 0 to 4 (fixed values).
LEVEL_MARKS = ("🟢", "🟡", "🟠", "🔴", "🤖")
LEVEL_WORDS = ("Likely human-made", "Slightly suspicious", "Possibly AI-generated", "Likely AI-generated", "Confirmed AI-generated")


def level_summary(rate) -> Column:
    at = lambda xs: F.element_at(F.array(*map(F.lit, xs)), score_level(rate) + 1)
    return F.concat(at(LEVEL_MARKS), F.lit(" "), F.floor(col(rate) * 100 + 0.5).cast("string"), F.lit("%  "), at(LEVEL_WORDS))


def parse_llm_score(text) -> Column:
    """An integer of 0 to 100 with a % or before /100, as a share; else 0.5 and 0.3 more or less for each telling word."""
    # only words that are such numbers are taken out, as few are; what stands before is looked at only where one may begin
    number = rf"(?=[-+\d])(?<![^{SPACES}])(?:\+?|-(?=0+(?!\d)))0*(\d{{1,3}})"
    words = F.regexp_extract_all(col(text), F.lit(rf"{number}(?:[.,!?]*%[.,!?%]*(?![^{SPACES}])|[.,!?%]*(?=[{SPACES}]+/100(?![^{SPACES}])))"), F.lit(1))
    words = F.when(col(text).contains("%") | col(text).contains("/100"), words)
    hits = F.filter(words, lambda n: n.cast("int") <= 100)
    low = F.lower(col(text))
    votes = sum((F.when(low.contains(w), 3).otherwise(0) for w in AI_WORDS), F.lit(0)) - sum((F.when(low.contains(w), 3).otherwise(0) for w in HUMAN_WORDS), F.lit(0))
    guess = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (votes + 5) / 10.0))
    return F.when(F.size(hits) > 0, hits[0].cast("int") / 100.0).otherwise(guess)


def seconds(s) -> Column:
    """[[hh:]mm:]ss(.f) in seconds, 0 for ''; null for others, negative parts and blanks among them."""
    parts = F.transform(F.split(col(s), ":"), lambda x: F.when(x.rlike(r"\s"), None).otherwise(x.try_cast("double")))
    bad = (F.size(parts) > 3) | F.exists(parts, lambda x: x < 0)
    return F.when(col(s) == "", 0.0).when(bad, None).otherwise(F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x))


def meaningful_chars(text) -> Column:
    return F.length(F.regexp_replace(col(text), r"[\s\p{P}\p{Nd}]", ""))


def strip_reserved(q, keep_hyphen: bool = False) -> Column:
    """Query operators to blanks, quotes removed, blanks squeezed."""
    t = F.replace(col(q), F.lit('"'), F.lit(""))
    t = F.regexp_replace(t, r"[+*()~]" if keep_hyphen else r"[+\-*()~]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def quoted(term) -> Column:
    return F.regexp_replace(col(term), r"([\\.\[\]{}()*+?^$|-])", r"\\$1")


def contains_word(text, term) -> Column:
    """Case-insensitive, between characters that are no ASCII letters or digits; never for a blank term."""
    t = F.lower(F.trim(col(term)))
    return (t != "") & F.regexp_like(F.lower(col(text)), F.concat(F.lit("(?<![a-z0-9])"), quoted(t), F.lit("(?![a-z0-9])")))


def is_english_line(line) -> Column:
    """Over 0.7 of the ASCII characters and ideographs are ASCII, blanks and fillers aside."""
    t = F.regexp_replace(col(line), f"[ {FILLER}]", "")
    ascii_n = F.length(F.regexp_replace(t, r"[^\x00-\x7F]", ""))
    han = F.length(F.regexp_replace(t, "[^一-鿿]", ""))
    return (ascii_n + han > 0) & (ascii_n / F.greatest(ascii_n + han, F.lit(1)) > 0.7)


def cjk_latin_spacing(text) -> Column:
    """A blank between a CJK character and an ASCII letter or digit, but none after an opening or before a closing bracket."""
    after = f"(?<=[{WIDE}&&[^{WIDE_OPEN}]])(?=[A-Za-z0-9])"
    before = f"(?<=[A-Za-z0-9])(?=[{WIDE}&&[^{WIDE_CLOSE}]])"
    return F.regexp_replace(col(text), f"{after}|{before}", " ")


def post_process_line(text, table: dict[str, str] | None = None) -> Column:
    """Fillers to blanks, blanks squeezed and trimmed; a blank after . and , before an ASCII letter and after each of : ; ? ! that something follows; then the corrections of table."""
    t = F.regexp_replace(F.replace(col(text), F.lit(FILLER), F.lit(" ")), " +", " ")
    t = F.regexp_replace(t, r"^[\s\p{Z}\x85]+|[\s\p{Z}\x85]+$", "")
    t = F.regexp_replace(t, r"(?s)[.,](?=[A-Za-z])|[:;?!](?=.)", "$0 ")
    return apply_corrections(t, table or {})


def fix_digit_confusion(text, table: dict[str, str] | None = None) -> Column:
    """1 between ASCII letters, or after one at the end of the text, to l; 0 between them to O, after one at the end to o; then the corrections of table."""
    t = F.regexp_replace(col(text), r"(?<=[A-Za-z])1(?=[A-Za-z]|\z)", "l")
    t = F.regexp_replace(t, r"(?<=[A-Za-z])0(?=[A-Za-z])", "O")
    return apply_corrections(F.regexp_replace(t, r"(?<=[A-Za-z])0\z", "o"), table or {})


def apply_corrections(text, table: dict[str, str]) -> Column:
    return reduce(lambda c, k: F.replace(c, F.lit(k), F.lit(table[k])), sorted(table, key=lambda k: (-len(k), k)), col(text))


def word_separator(a, b) -> Column:
    """What joins two pieces of a line: nothing between CJK characters, after a hyphen and before punctuation, else a blank; nothing if one is empty."""
    x, y = F.substring(col(a), -1, 1), F.substring(col(b), 1, 1)
    wide = f"[{WIDE}]"
    return F.when((x == "") | (y == "") | (x == "-") | (x.rlike(wide) & y.rlike(wide)) | y.rlike(r"\p{P}"), "").otherwise(" ")


def levenshtein_bytes(a, b) -> Column:
    """Edit distance in bytes."""
    return F.levenshtein(*(F.decode(F.encode(col(c), "UTF-8"), "ISO-8859-1") for c in (a, b)))


def glob_pattern(glob: Column) -> Column:
    g = F.regexp_replace(glob, r"([.+^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(g, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def and_filter(tokens: Column, terms: Column) -> Column:
    """All terms are among the tokens; true for no terms."""
    return F.size(F.array_except(terms, tokens)) == 0


def param_summary(params: Column) -> Column:
    """Parameters (map of name to struct kind, values, least, most) as text, by name: a flag's name, name=a|b with at most six values, name=least-most."""

    def one(e):
        k, p = e["key"], e["value"]
        few = F.when(F.size(p["values"]) > 6, F.concat(F.slice(p["values"], 1, 6), F.array(F.lit("...")))).otherwise(p["values"])
        span = F.concat(k, F.lit("="), p["least"].cast("string"), F.lit("-"), p["most"].cast("string"))
        return F.when(p["kind"] == "boolean", k).when(p["kind"] == "enum", F.concat(k, F.lit("="), F.array_join(few, "|"))).when(p["kind"] == "range", F.coalesce(span, k))

    return F.array_join(F.array_compact(F.transform(F.array_sort(F.map_entries(params)), one)), ", ")


#: Media types of images by extension, and extensions of audio and image files (fixed values).
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "jfif": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp"}
AUDIO = ("wav", "mp3", "flac", "ogg", "opus", "aac", "m4a", "pcm")
IMAGE = ("png", "jpg", "jpeg", "jfif", "gif", "webp", "bmp")


def mime_type(ext) -> Column:
    """The media type of an image's extension; '' for others."""
    return reduce(lambda c, kv: c.when(col(ext) == kv[0], kv[1]), MIME.items(), F.when(F.lit(False), "")).otherwise("")


def is_audio(ext) -> Column:
    return F.lower(col(ext)).isin(*AUDIO)


def is_image(ext) -> Column:
    return F.lower(col(ext)).isin(*IMAGE)


def is_likely_image(content) -> Column:
    """Bytes of four or more that start as a PNG, JPEG, GIF or (more than 12 of them) WebP do."""
    h = F.hex(F.substring(col(content), 1, 12))
    webp = h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250") & (F.octet_length(col(content)) > 12)
    return (F.octet_length(col(content)) >= 4) & (h.startswith("89504E47") | h.startswith("FFD8FF") | h.startswith("47494638") | webp)
