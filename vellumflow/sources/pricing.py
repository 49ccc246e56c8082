"""Price snapshots: JSON in, one row for each model name and alias out."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from pathlib import Path
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "alias string, display_name string, input_price double, output_price double"


def price_rows(snapshot: dict) -> list[tuple[str, str, float, float]]:
    """(alias, display name, input, output price a million tokens) of every model under its key and its aliases, in order of
    alias; a snapshot without models is an error."""
    rows = {}
    for key, model in snapshot.get("models", {}).items():
        standard = model["standard"]
        for alias in (key, *model.get("aliases", ())):
            rows.setdefault(alias, (alias, model.get("display_name", key), float(standard["input_usd_per_million_tokens"]), float(standard["output_usd_per_million_tokens"])))
    if not rows:
        raise ValueError("the snapshot names no models")
    return [rows[a] for a in sorted(rows)]


def load_prices(spark: SparkSession, path: str | Path) -> tuple[DataFrame, dict]:
    """Prices of a snapshot file, and what identifies it (content hash, size)."""
    content = Path(path).read_bytes()
    meta = {"content_sha256": hashlib.sha256(content).hexdigest(), "size": len(content), "source": str(path)}
    return spark.createDataFrame(price_rows(json.loads(content.decode("utf-8", "replace"))), SCHEMA), meta


def fetch_snapshot(url: str, extract: Callable[[str], dict], etag: str | None = None, timeout: float = 30) -> tuple[dict, dict] | None:
    """(snapshot, what identifies it) of a price page over HTTP, none if it still is the one of ``etag``.

    ``extract`` makes a snapshot of the page's text, which is decoded with replacement. A page that can't be had, or from which
    no model can be read, is a ValueError.
    """
    request = Request(url, headers={"Accept": "text/html,application/json", **({"If-None-Match": etag} if etag else {})})
    try:
        with urlopen(request, timeout=timeout) as response:
            content, headers = response.read(), response.headers
    except HTTPError as e:
        if e.code == 304:
            return None
        raise ValueError(str(e)) from e
    except (URLError, OSError) as e:
        raise ValueError(str(e)) from e
    snapshot = extract(content.decode("utf-8", "replace"))
    price_rows(snapshot)
    meta = {"source": url, "content_type": headers.get_content_type(), "content_sha256": hashlib.sha256(content).hexdigest(), "size": len(content), "etag": headers.get("ETag"), "last_modified": headers.get("Last-Modified")}
    return snapshot, meta


def model_listing(models: DataFrame, prices: DataFrame) -> DataFrame:
    """Model catalogue (model_name, input_token_limit, output_token_limit) with prices as text, '?' where unknown, by name."""
    from vellumflow.functions import text
    from vellumflow.operators.costs import priced_models

    priced = models.join(priced_models(models, prices), "model_name", "left")
    return priced.select("model_name", text.limit("input_token_limit").alias("input_limit"), text.limit("output_token_limit").alias("output_limit"), text.price("input_price").alias("input_price"), text.price("output_price").alias("output_price")).orderBy("model_name")
