"""URL and file-name functions. Only transliterating names needs Python, on Arrow batches."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.values import filled, trimmed


# Ports, patterns, brand and product tokens.
PORTS = {"http": 80, "https": 443, "ftp": 21}
SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*"
URL = re.compile(rf"(?:({SCHEME}):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?", re.S)
HOST = r"\[[0-9A-Fa-f:.]+\]|[^:\[\]]*"
DOTS = r"(\A|/)\.{1,2}(/|\z)"
#: What is percent-encoded in a path, a query and a fragment.
ENCODED = {"path": r"""[^!-~]|["<>`{}]""", "query": r"""[^!-~]|["<>']""", "fragment": r"""[^!-~]|["<>`]"""}
#: A URL that resolving leaves as it is, if it has no dot segment: lower-case scheme and host, a path, nothing to encode.
CLEAN = r"\Ahttps?://[a-z0-9.-]+/[A-Za-z0-9._~!$&*+,;=:@/?%-]*(#[A-Za-z0-9._~-]*)?\z"
#: Plain paths, and bases to which they can be joined as they are.
PATH = re.compile(r"/?[A-Za-z0-9_~!$&*+,=%-][A-Za-z0-9._~!$&*+,=/%-]*")
BASE = re.compile(r"(https?://[a-z0-9.-]+)(/(?:[A-Za-z0-9._~!$&*+,=%-]*/)*)?[A-Za-z0-9._~!$&*+,=%-]*(?:[?#]|\Z)")


JAVA_BASE = BASE.pattern.replace(r"\Z", r"\z")


def _stripped(text: str) -> str:
    return re.sub(r"[\t\n\r]", "", text).strip("".join(map(chr, range(33))))


def _without_dots(path: str) -> str:
    out, parts = [], path.split("/")[1:]
    for x in parts:
        if x == "..":
            del out[-1:]
        elif x != ".":
            out.append(x)
    return "/" + "/".join(out + [""] * (parts[-1] in (".", "..")))


@functools.lru_cache(1024)
def resolve(value: str | None, base: str | None) -> str:
    """value against base as a browser would; '' if there is no absolute URL. The same as absolute(), for use while a page is parsed."""
    if not value:
        return ""
    if PATH.fullmatch(value) and "./" not in value and value[-1] != "." and (m := BASE.match(base or "")) and "./" not in (m[2] or ""):
        return m[1] + value if value[0] == "/" else f"{m[1]}{m[2] or '/'}{value}"
    own = _stripped(value)
    scheme, host, path, query, fragment = URL.fullmatch(own).groups()
    if scheme is None:
        scheme, b_host, b_path, b_query, _ = URL.fullmatch(_stripped(base or "")).groups()
        if (scheme or "").lower() not in PORTS:
            return ""
        if host is None:
            host = b_host
            if not path:
                path, query = b_path, b_query if query is None else query
            elif path[0] != "/":
                path = (b_path[: b_path.rfind("/") + 1] or "/") + path
    elif scheme.lower() not in PORTS:
        return scheme.lower() + own[len(scheme) :]
    scheme = scheme.lower()
    user, at, host = (host or "").rpartition("@")
    found = re.fullmatch(rf"({HOST})(?::([0-9]*))?", host)
    host, port = found.groups() if found else ("", "")
    if not host or " " in host or int(port or 0) > 65535:
        return ""
    port = "" if not port or int(port) == PORTS[scheme] else f":{int(port)}"
    if re.search(r"(^|/)\.{1,2}(/|\Z)", path):
        path = _without_dots(path)
    encode = lambda x, kind: re.sub(ENCODED[kind], lambda m: "".join(f"%{b:02X}" for b in m[0].encode(errors="replace")), x)
    return f"{scheme}://{user}{at}{host.lower()}{port}{encode(path or '/', 'path')}" + (f"?{encode(query, 'query')}" if query is not None else "") + (f"#{encode(fragment, 'fragment')}" if fragment is not None else "")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def _encode(text: Column, kind: str) -> Column:
    hexed = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    chars = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.when(c.rlike(f"(?s){ENCODED[kind]}"), hexed(c)).otherwise(c))
    return F.when(text.rlike(ENCODED[kind]), F.array_join(chars, "")).otherwise(text)


def _with_parts(text: Column, then: Callable[[Column], Column]) -> Column:
    """then(parts of a URL); has_host, has_query and has_fragment tell empty ones from absent ones."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t\n\r]", ""), r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")
    begun = lambda t: F.struct(F.lower(F.regexp_extract(t, rf"\A({SCHEME}):", 1)).alias("scheme"), F.regexp_replace(t, rf"\A{SCHEME}:", "").alias("rest"))
    told = lambda x: F.struct(x["scheme"].alias("scheme"), x["rest"].alias("rest"), F.regexp_extract(x["rest"], r"\A//([^/?#]*)", 1).alias("host"), x["rest"].startswith("//").alias("has_host"), F.regexp_replace(x["rest"], r"\A//[^/?#]*", "").alias("tail"))
    split = lambda x: F.struct(*[x[c].alias(c) for c in ("scheme", "rest", "host", "has_host")], F.regexp_extract(x["tail"], r"\A([^?#]*)", 1).alias("path"), F.regexp_extract(x["tail"], r"\A[^?#]*\?([^#]*)", 1).alias("query"), x["tail"].rlike(r"\A[^?#]*\?").alias("has_query"), F.regexp_extract(x["tail"], r"(?s)\A[^#]*#(.*)\z", 1).alias("fragment"), x["tail"].contains("#").alias("has_fragment"))
    return _let(text, lambda t: _let(begun(t), lambda x: _let(told(x), lambda y: _let(split(y), then))))


def _undotted(path: Column) -> Column:
    none = F.array().cast("array<string>")
    fold = lambda out, x: F.when(x == ".", out).when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(x)))
    joined = lambda parts: F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), none, fold), F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)), "/"))
    return F.when(path == "", "/").when(path.rlike(DOTS), _let(F.split(path, "/", -1), joined)).otherwise(path)


def _joined(v: Column, b: Column) -> Column:
    """The URL of the parts v against those of a base."""
    own, known = v["scheme"] != "", lambda x: x["scheme"].isin(*PORTS)
    bare = (v["scheme"] == "") & ~v["has_host"]
    folder = F.regexp_extract(b["path"], r"(?s)\A(.*/)", 1)
    path = F.when(~bare | v["path"].startswith("/"), v["path"]).when(v["path"] == "", b["path"]).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), v["path"]))
    asks = F.when(bare & (v["path"] == "") & ~v["has_query"], F.struct(b["has_query"].alias("has"), b["query"].alias("text"))).otherwise(F.struct(v["has_query"].alias("has"), v["query"].alias("text")))
    place = F.when(bare, b["host"]).otherwise(v["host"])
    first = F.struct(F.when(own, v["scheme"]).otherwise(b["scheme"]).alias("scheme"), F.regexp_extract(place, r"(?s)\A(.*@)", 1).alias("user"), F.regexp_replace(place, r"(?s)\A.*@", "").alias("place"), path.alias("path"), asks.alias("asks"))
    digits = lambda x: F.regexp_extract(x["place"], r":([0-9]*)\z", 1)
    second = lambda x: F.struct(*[x[c].alias(c) for c in ("scheme", "user", "path", "asks")], F.regexp_extract(x["place"], rf"\A({HOST})(:[0-9]*)?\z", 1).alias("host"), F.when(digits(x) != "", F.coalesce(digits(x).try_cast("int"), F.lit(1 << 20))).alias("port"))
    usual = F.create_map(*[F.lit(x) for pair in PORTS.items() for x in pair])
    tail = lambda mark, has, text, kind: F.when(~has, "").otherwise(F.concat(F.lit(mark), _encode(text, kind)))
    port = lambda x: F.when(x["port"].isNull() | (x["port"] == F.try_element_at(usual, x["scheme"])), "").otherwise(F.concat(F.lit(":"), x["port"].cast("string")))
    url = lambda x: F.concat(x["scheme"], F.lit("://"), x["user"], F.lower(x["host"]), port(x), _let(_undotted(x["path"]), lambda p: _encode(p, "path")), tail("?", x["asks"]["has"], x["asks"]["text"], "query"), tail("#", v["has_fragment"], v["fragment"], "fragment"))
    bad = lambda x: (x["host"] == "") | x["host"].contains(" ") | F.coalesce(x["port"] > 65535, F.lit(False))
    return F.when(own & ~known(v), F.concat(v["scheme"], F.lit(":"), v["rest"])).when(~own & ~known(b), "").otherwise(_let(first, lambda x: _let(second(x), lambda y: F.when(bad(y), "").otherwise(url(y)))))


def absolute(value: Column, base: Column) -> Column:
    """value against base as a browser would; '' where there is no value or no absolute URL.

    Column expressions only: the parts of both are split by patterns, the path is merged and its dot segments are folded, and what may
    not stand in a URL is percent-encoded. Ports that are the scheme's default go, the host is lowered; other schemes than http, https and
    ftp keep their text. Empty segments stay. Clean URLs, and plain paths on plain bases, take a short way to the same result."""
    base = F.coalesce(base, F.lit(""))
    clean = value.rlike(CLEAN) & ~value.rlike(r"/\.{1,2}(/|\z|\?|#)")
    plain = value.rlike(rf"\A{PATH.pattern}\z") & ~value.contains("./") & ~value.endswith(".") & base.rlike(rf"\A{JAVA_BASE}") & ~base.contains("./")
    folder = F.regexp_extract(base, rf"\A{JAVA_BASE}", 2)
    short = F.concat(F.regexp_extract(base, rf"\A{JAVA_BASE}", 1), F.when(value.startswith("/"), "").when(folder == "", "/").otherwise(folder), value)
    return F.when(F.coalesce(value, F.lit("")) == "", "").when(clean, value).when(plain, short).otherwise(_with_parts(value, lambda v: _with_parts(base, lambda b: _joined(v, b))))


def normalized(value: Column, base: Column) -> Column:
    """As absolute, but '' for 'undefined', 'null' and '[object X]', and the text itself where it can't be resolved."""
    text = trimmed(F.coalesce(value, F.lit("")))
    void = (text == "") | text.isin("undefined", "null") | text.rlike(r"(?i)\A\[object\s+\w+\]\z")
    return F.when(void, "").otherwise(filled(absolute(text, base), text))


def displayed(value: Column, origin: Column) -> Column:
    """For showing: absolute and data URLs as they are, '//' with the origin's scheme, '/' with the origin."""
    text = trimmed(F.coalesce(value, F.lit("")))
    scheme = F.regexp_extract(origin, r"\A([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    return F.when(text == "", "").when(text.rlike(r"(?i)\A(https?:|data:)"), text).when(text.startswith("//"), F.concat(scheme, text)).when(text.startswith("/"), F.concat(origin, text)).otherwise(filled(absolute(text, origin), text))


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def has_scheme(url: Column) -> Column:
    return F.coalesce(part(url, "PROTOCOL"), F.lit("")) != ""


def model_name(url: Column, empty: str = "Scrape Job", rootless: str = "category") -> Column:
    """A title from the last path segment: no extension, split at - and _; brand tokens and tokens with digits in capitals.

    rootless: the segment that stands for an empty path. empty: the result for no URL or no tokens."""
    segments = F.filter(F.split(F.coalesce(part(url, "PATH"), F.lit("")), "/"), lambda s: s != "")
    last = F.coalesce(F.get(segments, F.size(segments) - 1), F.lit(rootless))
    tokens = F.filter(F.split(F.regexp_replace(last, r"(?i)\.[a-z0-9]+\z", ""), "[-_]+"), lambda t: t != "")
    shown = F.transform(
        tokens,
        lambda t: F.when(t.rlike(r"(?i)\A(lg|htc|zte|nokia|iphone|ipad)\z"), F.upper(t)).when(F.lower(t) == "thinq", F.lit("ThinQ")).when(t.rlike(r"(?i)\A[a-z]*[0-9]+[a-z0-9]*\z"), F.upper(t)).otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, F.lit(2), F.length(t))))),
    )
    return F.when(has_scheme(url) & (F.size(tokens) > 0), F.array_join(shown, " ")).otherwise(F.lit(empty))


def is_product(url: Column, site: str = "") -> Column:
    """Whether a URL looks like one product's page; ordered rules, the first that applies decides.

    site: part of the host name whose replacement-parts trees are never products (none if empty)."""
    path, host = F.lower(F.coalesce(part(url, "PATH"), F.lit(""))), F.lower(F.coalesce(part(url, "HOST"), F.lit("")))
    path = F.when(path == "", "/").otherwise(path)
    query = F.lower(F.coalesce(part(url, "QUERY"), F.lit("")))
    asked = F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))
    rules = [
        (~has_scheme(url), False),
        (path.contains("/product/"), True),
        (path.rlike("/(p|item|sku|product-|view|details|product-detail|pd)/"), True),
        (path.rlike("/(apple|samsung|iphone|galaxy|ipad|airpods|watch)/"), True),
        (asked.contains("product_id=") | asked.contains("?id=") | asked.contains("?sku=") | asked.contains("?item_id="), True),
        (path.rlike("/(products?|items?|listings?|offers?|deals?)/[0-9]+"), True),
        *([(host.contains(site) & path.contains("/replacement-parts/"), False)] if site else []),
        (path.rlike(r"(\A|/)[a-z0-9-]+-series(/|\z)"), False),
        (path.rlike("(category|collection|catalog|shop|browse|search|results|list|page)/"), False),
        (path.rlike("[a-z0-9]+-[a-z0-9]+-[a-z0-9]+") & ~asked.contains("category"), True),
    ]
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for test, value in rules[1:]:
        out = out.when(test, F.lit(value))
    return out.otherwise(F.lit(False))


@F.pandas_udf(T.StringType())
def _plain(value: pd.Series) -> pd.Series:
    return value.map(lambda v: re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", v)), na_action="ignore")


def slug(value: Column, fallback: str = "item", ascii_only: bool = False) -> Column:
    """Lower case, letters without marks, all else runs of one underscore. ascii_only: the values have no other characters, so no Python is needed."""
    text = F.coalesce(value, F.lit(""))
    text = text if ascii_only else _plain(text)
    text = F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9]+", "_"), r"\A_+|_+\z", "")
    return filled(F.lower(text), F.lit(fallback))


def safe_id(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), "[^a-zA-Z0-9_-]", "")


def archive_name(model: Column, job_id: Column, ascii_only: bool = False) -> Column:
    name = slug(filled(model, F.concat(F.lit("job_"), job_id)), "job", ascii_only)
    return F.concat(F.substring(name, 1, 80), F.lit("_"), job_id, F.lit(".zip"))


def image_filename(url: Column, n: Column) -> Column:
    """The last path part, without the query, percent-decoded; image_{n}.jpg if empty."""
    last = F.regexp_extract(F.coalesce(url, F.lit("")), r"([^/]*)\z", 1)
    raw = F.regexp_replace(last, r"\?.*\z", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    return filled(decoded, F.concat(F.lit("image_"), n.cast("string"), F.lit(".jpg")))


def jpg_filename(url: Column, n: Column) -> Column:
    name = image_filename(url, n)
    return F.when(F.lower(name).rlike(r"\.jpe?g\z"), name).otherwise(F.concat(F.regexp_replace(name, r"\.[^.]*\z", ""), F.lit(".jpg")))


def first_srcset(value: Column) -> Column:
    """The first URL of a srcset attribute (or the text itself)."""
    return F.element_at(F.split(trimmed(F.element_at(F.split(F.coalesce(value, F.lit("")), ",", 2), 1)), r"\s", 2), 1)


def css_url(value: Column) -> Column:
    return F.regexp_extract(F.coalesce(value, F.lit("")), r"""url\(['"]?([^'")]+)['"]?\)""", 1)
