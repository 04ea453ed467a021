"""Identity of web resources: canonical URLs, content keys, source ids, hosts."""

from __future__ import annotations

import ipaddress
import socket

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

#: scheme, host, port, path, query; user info and fragment are matched and dropped.  Hosts may be IPv6 addresses in brackets.
URL_PATTERN = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?(?:#.*)?$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def url_host(url: Column | str) -> Column:
    """Host of a URL in lower case, IPv6 addresses without brackets; empty for what is no URL, null for null."""
    return F.translate(F.lower(F.regexp_extract(F.trim(_c(url)), URL_PATTERN, 2)), "[]", "")


def canonical_url(url: Column | str) -> Column:
    """One form for all spellings of a URL.

    Scheme and host in lower case, no user info, no default port, no fragment, ``/`` for an
    empty path; path and query stay as they are.  What is no absolute URL comes back trimmed.
    Null stays null.
    """
    u = F.trim(_c(url))
    part = lambda i: F.regexp_extract(u, URL_PATTERN, i)
    scheme, port, path, query = F.lower(part(1)), part(3), part(4), part(5)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    built = F.concat(
        scheme, F.lit("://"), F.translate(F.lower(part(2)), "[]", ""), F.when(default, "").otherwise(F.concat(F.lit(":"), port)),
        F.when(path == "", "/").otherwise(path), F.when(query == "?", "").otherwise(query),
    )
    return F.when(u.isNull(), F.lit(None)).when(part(2) == "", u).otherwise(built)


def content_key(url: Column | str) -> Column:
    """Key of the resource that a URL names."""
    return F.concat(F.lit("url:"), F.sha2(canonical_url(url), 256))


def short_source_id(prefix: str, url: Column | str, digits: int = 16) -> Column:
    """A source id for sources that have none of their own: prefix and a short hash of the URL."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(canonical_url(url), 256), 1, digits))


def feed_source_id(feed_url: Column | str, native: Column | str, digits: int = 20) -> Column:
    """A source id for a feed entry, from the configured URL of the feed and the entry's own id."""
    return F.concat(F.lit("rss-"), F.substring(F.sha2(F.concat(_c(feed_url), F.lit("\0"), _c(native)), 256), 1, digits))


# Names of feed files that say nothing about the feed.
DULL_FEED_NAMES = ("", "feed", "rss", "atom", "index.xml", "feed.xml", "rss.xml", "atom.xml")


def default_feed_folder(url: Column | str) -> Column:
    """A folder name for a feed without one: its host, and the name of its file if that says something."""
    host = F.coalesce(F.nullif(url_host(url), F.lit("")), F.lit("RSS Feed"))
    leaf = F.regexp_extract(F.regexp_replace(F.regexp_extract(F.trim(_c(url)), URL_PATTERN, 4), "/+$", ""), "([^/]*)$", 1)
    dull = F.lower(leaf).isin(*DULL_FEED_NAMES)
    stem = F.regexp_replace(leaf, r"\.[^.]*$", "")
    return F.when(dull | (stem == ""), host).otherwise(F.concat(host, F.lit(" - "), stem))


def _public(host: str) -> bool:
    """Whether a host may be asked: a public address in any way of writing it, or a name that is not local."""
    try:
        address = ipaddress.ip_address(host.split("%", 1)[0])
    except ValueError:
        try:  # 127.1, 0x7f.1, 2130706433: what resolvers take for an IPv4 address
            address = ipaddress.ip_address(socket.inet_aton(host))
        except OSError:
            name = host.rstrip(".")
            return bool(name) and name != "localhost" and not name.endswith((".localhost", ".local", ".internal"))
    mapped = getattr(address, "ipv4_mapped", None)
    if mapped is not None:
        address = mapped
    return address.is_global and not address.is_multicast


@arrow_udf(T.BooleanType())
def _is_public(hosts: pa.Array) -> pa.Array:
    return pa.array([None if h is None else _public(h) for h in hosts.to_pylist()], pa.bool_())


def safe_to_fetch(url: Column | str, allowed_hosts: tuple[str, ...] = ()) -> Column:
    """Whether a URL is http or https, has a host, and the host is no address that is not public, however it is written.

    Hosts in ``allowed_hosts`` are safe.  Resolving names is left to whoever fetches, who has to
    ask this of each address again.
    """
    scheme, host = F.lower(F.regexp_extract(F.trim(_c(url)), URL_PATTERN, 1)), url_host(url)
    allowed = host.isin(*[h.lower() for h in allowed_hosts]) if allowed_hosts else F.lit(False)
    # only what may be an address goes to Python
    literal = host.rlike(r"^(?:0[xX])?[0-9a-fA-F.:%]*[0-9.:][0-9a-fA-Fx.:%]*$|:")
    local = host.rlike(r"(?:^|\.)(?:localhost|local|internal)\.?$")
    return F.coalesce(scheme.isin("http", "https") & (host != "") & (allowed | F.when(literal, _is_public(host)).otherwise(~local)), F.lit(False))


def content_url(url: Column | str) -> Column:
    """Where the contents of a page are: an archive that shows pages in a frame has them below ``/ref``."""
    path = F.regexp_extract(F.trim(_c(url)), URL_PATTERN, 4)
    framed = (url_host(url) == FRAMING_ARCHIVE) & ~path.startswith("/ref/")
    return F.when(F.coalesce(framed, F.lit(False)), F.regexp_replace(_c(url), r"^(\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", "$1/ref")).otherwise(_c(url))


# The host of that archive, and the address of stars of a comment.
FRAMING_ARCHIVE = "megalodon.jp"
STAR_PAGE = "https://b.hatena.ne.jp/"


def star_url(user: Column | str, posted_at: Column | str, entry_id: Column | str) -> Column:
    """The address under which a comment's stars are counted; empty if its user, day or entry is missing."""
    day = F.regexp_replace(F.substring(F.coalesce(_c(posted_at), F.lit("")), 1, 10), "[^0-9]", "")
    ok = (F.coalesce(_c(user), F.lit("")) != "") & (F.length(day) == 8) & (F.coalesce(_c(entry_id), F.lit("")) != "")
    return F.when(ok, F.concat(F.lit(STAR_PAGE), _c(user), F.lit("/"), day, F.lit("#bookmark-"), _c(entry_id))).otherwise("")
