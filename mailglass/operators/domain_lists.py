"""Lists of domains: entries made plain, and which of them another entry already covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailglass.functions.names import listed_domain, listed_host


def normalised(entries: DataFrame, entry_col: str = "entry") -> DataFrame:
    """host, domain: each host that the entries name, once, with its registrable domain. Entries that name none are left out."""
    e = F.col(entry_col)
    return entries.select(listed_host(e).alias("host"), listed_domain(e).alias("domain")).filter("host <> ''").distinct()


def covered(hosts: DataFrame) -> DataFrame:
    """hosts (host, ...) with parent: the nearest other listed host that each lies under; null if it stands for itself.

    A host asks for each of its own suffixes by equality, so no host is compared with hosts that it does not lie under.
    """
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = hosts.select("host").filter(F.size(labels) > 1).select("host", F.posexplode(parents).alias("up", "parent"))
    found = asked.join(hosts.select(F.col("host").alias("parent")), "parent").groupBy("host").agg(F.min_by("parent", "up").alias("parent"))
    return hosts.join(found, "host", "left")


def list_of_domains(entries: DataFrame, entry_col: str = "entry") -> DataFrame:
    """domain, entries: the registrable domains of a list, with how many hosts each stands for."""
    return normalised(entries, entry_col).groupBy("domain").agg(F.count("*").alias("entries"))
