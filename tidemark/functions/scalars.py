"""Small column functions of the mirror."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: account types and the kinds they become
ACTOR_KINDS = {"User": "user", "Bot": "bot", "Mannequin": "mannequin", "Organization": "organization", "EnterpriseUserAccount": "enterprise_user_account"}


def actor_kind(type_name: Column, login: Column) -> Column:
    """An account's kind; without a login it is deleted, with an unlisted type unknown."""
    known = F.create_map(*[F.lit(x) for pair in ACTOR_KINDS.items() for x in pair])
    return F.when(F.coalesce(login, F.lit("")) == "", "deleted").otherwise(F.coalesce(known[type_name], F.lit("unknown")))


def count_label(n: Column) -> Column:
    """A count as one of four labels, so that metrics stay bounded."""
    return F.when(n <= 0, "0").when(n <= 5, "1_5").when(n <= 25, "6_25").otherwise("26_plus")


def owner_type(token: Column) -> Column:
    """user, team, email or malformed."""
    part = r"[\p{L}\p{N}_-]+"
    return (
        F.when(token.rlike(rf"^@{part}$"), "user")
        .when(token.rlike(rf"^@{part}/{part}$"), "team")
        .when(token.rlike(r"^[^@ /\t]+@[^@ /\t]+$"), "email")
        .otherwise("malformed")
    )


def known_sha(sha: Column) -> Column:
    """An all-zero or missing commit name is unknown, written as an empty one."""
    return F.when(F.coalesce(sha, F.lit("")).rlike("^0*$"), "").otherwise(sha)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1_000_000
