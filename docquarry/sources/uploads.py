"""Checks on what comes from outside: paths, upload batches, URLs and hosts."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import EXTENSIONS, MAX_BYTES

#: Files and bytes of an upload, and redirects that a download may follow.
MOST_FILES, MOST_BYTES, MOST_REDIRECTS = 200, 500 << 20, 5


def path_error(path: Column) -> Column:
    """Why a relative path is refused: empty, absolute, drive, parent (..) or nul; null if it is good."""
    p = F.translate(F.trim(F.coalesce(path, F.lit(""))), "\\", "/")
    parts = F.split(p, "/")
    return (
        F.when(p == "", "empty").when(p.contains("\u0000"), "nul").when(p.startswith("/"), "absolute").when(p.rlike("^[A-Za-z]:"), "drive")
        .when(F.array_contains(parts, ".."), "parent").when(F.forall(parts, lambda x: x.isin("", ".")), "empty")
    )


def clean_path(path: Column) -> Column:
    """A good path with slashes, without empty parts and dots."""
    return F.array_join(F.filter(F.split(F.translate(F.trim(path), "\\", "/"), "/"), lambda x: ~x.isin("", ".")), "/")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def check_batch(files: DataFrame, extensions: tuple = EXTENSIONS, max_bytes: int = MAX_BYTES, most: int = MOST_FILES, total: int = MOST_BYTES) -> DataFrame:
    """(batch, pos, path, error, accepted) of uploads (batch, pos, path, length): a bad path, an unknown extension, an empty or too large file, a repeated path, too many files, or too many bytes so far. All or nothing: one error refuses the whole batch."""
    w = Window.partitionBy("batch").orderBy("pos")
    whole = Window.partitionBy("batch")
    clean = clean_path(F.col("path"))
    seen = F.row_number().over(Window.partitionBy("batch", F.lower(clean)).orderBy("pos"))
    sized = files.select("batch", "pos", "path", "length", clean.alias("clean"), seen.alias("seen"), F.sum("length").over(w).alias("upto"), F.count("*").over(whole).alias("n"))
    error = F.coalesce(
        path_error(F.col("path")), F.when(~extension(F.col("clean")).isin(*extensions), "extension"), F.when(F.col("length") <= 0, "empty_file"), F.when(F.col("length") > max_bytes, "too_large"),
        F.when(F.col("seen") > 1, "repeated"), F.when(F.col("n") > most, "too_many_files"), F.when(F.col("upto") > total, "too_many_bytes"),
    )
    checked = sized.withColumn("error", error)
    return checked.select("batch", "pos", F.when(F.col("error").isNull(), F.col("clean")).otherwise(F.col("path")).alias("path"), "error", (F.count("error").over(whole) == 0).alias("accepted"))


def url_error(url: Column) -> Column:
    """Why a URL is refused before anything is resolved: scheme, host, or a literal address that is not public."""
    u = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = url_host(u)
    return F.when(~scheme.isin("http", "https"), "scheme").when(host == "", "host").when(~is_public(host), "address")


def url_host(url: Column) -> Column:
    """Host of a URL, lower case, without user, port and brackets; empty if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(authority, "^.*@", "")
    return F.lower(F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(bare, r":\d*$", "")))


def url_file_name(url: Column) -> Column:
    """The last part of a URL's path, percent signs decoded; null without one or with one that is no file name."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    name = F.try_url_decode(F.replace(F.regexp_extract(path, r"([^/]*)$", 1), F.lit("+"), F.lit("%2B")))
    return F.when(name.rlike(r"^[^/\\]+$") & ~name.isin(".", ".."), name)


def url_file(url: Column, extensions: tuple = EXTENSIONS) -> Column:
    """struct(name, error) of the file that a URL names: no_name, extension, or null."""
    name = url_file_name(url)
    return F.struct(name.alias("name"), F.when(name.isNull(), "no_name").when(~extension(name).isin(*extensions), "extension").alias("error"))


@F.pandas_udf(T.BooleanType())
def is_public(host: pd.Series) -> pd.Series:
    """Whether a host may be asked: a literal address must be public; a name must not be a local one. Names are not resolved here; a downloader checks every address that they resolve to in the same way."""

    def one(h):
        if not h:
            return False
        try:
            a = ipaddress.ip_address(h.split("%")[0])
        except ValueError:
            return h != "localhost" and not h.endswith((".localhost", ".local", ".internal"))
        a = getattr(a, "ipv4_mapped", None) or a
        return not (a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified)

    return host.map(one).astype(bool)
