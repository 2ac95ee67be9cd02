"""Column functions on domain names, hosts and addresses."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Reserved top-level names, extended DNS error codes of filtering resolvers.
SPECIAL_USE = ("onion", "local", "localhost", "test", "invalid", "example")
FILTERING_ERRORS = (4, 6, 13, 15, 16, 17, 18, 19)
MOST_LABEL, MOST_NAME = 63, 253
_DENIED = r"[\x00-\x20\x7F%#/:<>?@\[\\\]^|]"
_V4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
#: IPv6 by its groups: eight, or fewer around one ``::``, the last two perhaps written as IPv4; then perhaps a scope.
_GROUP, _FOUR = "[0-9A-Fa-f]{1,4}", _V4[1:-1]
_LAST = f"({_GROUP}:{_GROUP}|{_FOUR})"
_GROUPS = [f"({_GROUP}:){{6}}{_LAST}", f"::({_GROUP}:){{5}}{_LAST}", f"({_GROUP})?::({_GROUP}:){{4}}{_LAST}"]
_GROUPS += [f"(({_GROUP}:){{0,{4 - n}}}{_GROUP})?::({_GROUP}:){{{n}}}{_LAST}" for n in (3, 2, 1, 0)]
_GROUPS += [f"(({_GROUP}:){{0,5}}{_GROUP})?::{_GROUP}", f"(({_GROUP}:){{0,6}}{_GROUP})?::"]
_V6 = rf"\A({'|'.join(_GROUPS)})(%[^%/]+)?\z"


def _punycode(name: str | None) -> str | None:
    """A name with characters beyond ASCII: UTS 46 mapping, then punycode label by label; null if it can't be."""
    if name is None:
        return None
    import idna

    try:
        labels = idna.uts46_remap(name, std3_rules=False, transitional=False).split(".")
        return ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in labels)
    except (idna.IDNAError, UnicodeError):
        return None


def normalize_domain(domain: Column) -> Column:
    """Comparison key of a domain, or null: one trailing dot off, lower case, labels of 1 to 63, 253 in all."""

    @F.arrow_udf("string")
    def encoded(names: pa.Array) -> pa.Array:
        return pa.array([_punycode(x) for x in names.to_pylist()], pa.string())

    bare = F.regexp_replace(domain, r"\.$", "")
    beyond = bare.rlike(r"[^\x00-\x7F]")
    key = F.when(beyond, encoded(F.when(beyond, bare))).otherwise(F.lower(bare))
    return valid_key(key)


def valid_key(key: Column) -> Column:
    labels = F.split(key, r"\.")
    fine = (key != "") & ~key.rlike(_DENIED) & F.forall(labels, lambda x: F.length(x).between(1, MOST_LABEL)) & (F.length(key) <= MOST_NAME)
    return F.when(fine, key)


def is_ip_literal(name: Column) -> Column:
    """IPv4 with plain octets, or anything with a colon that is IPv6."""
    return F.coalesce(name.rlike(_V4) | (F.contains(name, F.lit(":")) & name.rlike(_V6)), F.lit(False))


def reversed_labels(domain: Column) -> Column:
    return F.array_join(F.reverse(F.split(domain, r"\.")), ".")


def suffixes(host: Column) -> Column:
    """The host and all its parents, longest first: array of (suffix, depth in labels)."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("suffix"), (F.size(labels) - i + 1).alias("depth")))


def is_special_use(domain: Column) -> Column:
    return F.lower(F.element_at(F.split(F.regexp_replace(domain, r"\.$", ""), r"\."), -1)).isin(*SPECIAL_USE)


def looks_like_personal_name(label: Column) -> Column:
    """2 to 4 alphabetic ASCII tokens between ``-._``; never punycode."""
    tokens = F.filter(F.split(label, r"[-._]"), lambda t: t != "")
    return ~label.startswith("xn--") & F.size(tokens).between(2, 4) & F.forall(tokens, lambda t: t.rlike("^[A-Za-z]+$"))


def host_of_url(url: Column) -> Column:
    """Lower-case host of a url; null without one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))
    return F.when(host != "", host)


def ip_key(address: Column) -> Column:
    """An IPv4 address as 32 lower hex digits, mapped into IPv6; null for anything else (see ``hosts.ip_key_any``)."""
    octets = F.transform(F.split(address, r"\."), lambda o: F.lpad(F.lower(F.hex(o.cast("int"))), 2, "0"))
    return F.when(address.rlike(_V4), F.concat(F.lit("0" * 20 + "ffff"), F.array_join(octets, "")))
