"""Category names and other keys as they must compare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def category_name(name: Column | str) -> Column:
    """Without quotes, outer white space and a leading 'Category:'; underscores and runs of white space are one space."""
    plain = F.regexp_replace(F.translate(name, "'\"", ""), r"(?U)[\s_]+", " ")
    return F.trim(F.regexp_replace(F.trim(plain), r"(?i)^category:", ""))


# The numbers of the namespaces of a wiki by the prefix of a title.
NAMESPACES = {"talk": 1, "user": 2, "wikipedia": 4, "file": 6, "mediawiki": 8, "template": 10, "help": 12, "category": 14, "portal": 100, "draft": 118}


def namespace(title: Column | str) -> Column:
    """The number of the namespace a title lies in, 0 for articles; null for null."""
    prefix = F.lower(F.trim(F.regexp_extract(title, r"^([^:]*):", 1)))
    number = F.lit(0)
    for name, value in NAMESPACES.items():
        number = F.when(prefix == name, value).otherwise(number)
    return F.when((F.col(title) if isinstance(title, str) else title).isNotNull(), number)
