"""Rules about document addresses: URL or path, suffix, file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Suffixes of supported formats.
SUPPORTED_FORMATS = (
    ".pdf", ".docx", ".doc", ".txt", ".rtf", ".odt", ".pptx", ".ppt", ".xlsx",
    ".xls", ".html", ".htm", ".md", ".csv", ".json", ".xml", ".eml", ".msg",
)

# Names for addresses without a file name.
PDF_NAME, WORD_NAME, TEXT_NAME = "document.pdf", "document.docx", "document.txt"

_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"


def last_segment(path: Column) -> Column:
    """The last path segment; trailing slashes and single dots do not count."""
    trimmed = F.regexp_replace(path, r"(/+\.)*/*$", "")
    return F.regexp_extract(trimmed, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """The last suffix of a path, lower-cased; a leading dot starts none."""
    name = F.regexp_replace(last_segment(path), r"^\.+", "")
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def is_url(text: Column) -> Column:
    """True if there are both a scheme and a host."""
    return F.coalesce(text.rlike(_URL), F.lit(False))


def classify_sources(df: DataFrame, uri_col: str = "doc_uri") -> DataFrame:
    """Add ``is_url``, ``suffix`` and ``is_supported`` to a table of addresses.

    The suffix is taken from the whole string, query part included.
    """
    uri = F.col(uri_col)
    return df.withColumns(
        {
            "is_url": is_url(uri),
            "suffix": suffix(uri),
            "is_supported": suffix(uri).isin(*SUPPORTED_FORMATS),
        }
    )


def infer_source_name(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``source_name``: the file name a URL points to, or a stand-in.

    The stand-in depends on the whole URL, in any case of letters.
    """
    url = F.col(url_col)
    path = F.regexp_replace(url, r"[?#][\s\S]*$", "")
    path = F.regexp_replace(path, r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/]*)?", "")
    path = F.regexp_replace(path, r";[^/]*$", "")
    name = last_segment(path)
    lowered = F.lower(url)
    return df.withColumn(
        "source_name",
        F.when(name.contains("."), name)
        .when(lowered.contains("pdf"), PDF_NAME)
        .when(lowered.contains("doc"), WORD_NAME)
        .otherwise(TEXT_NAME),
    )
