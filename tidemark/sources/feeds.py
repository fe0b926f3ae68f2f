"""Feeds: RSS, RDF, Atom and JSON Feed bodies to rows of items."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

ITEM = "feed string, title string, link string, guid string, summary string, published string"
LARGEST = 20 << 20


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _children(node) -> dict:
    found: dict = {}
    for c in node:
        found.setdefault(_local(c.tag), []).append(c)
    return found


def parse_feed(body: str | None) -> list[tuple] | None:
    """Items of a feed as (title, link, guid, summary, published); null for what is no feed or beyond the size limit."""
    if not body or len(body) > LARGEST:
        return None
    body = body.strip()
    if body[:1] in "{[":
        try:
            data = json.loads(body)
        except ValueError:
            return None
        items = data.get("items") if isinstance(data, dict) else data
        if not isinstance(items, list):
            return None
        pick = lambda x, *names: next((str(x[n]) for n in names if x.get(n)), None)
        return [(pick(x, "title"), pick(x, "url", "link"), pick(x, "id", "guid"), pick(x, "content_html", "content_text", "summary"), pick(x, "date_published", "published")) for x in items if isinstance(x, dict)]
    if re.search(r"<!ENTITY", body, re.I):
        return None
    try:
        root = ET.fromstring(body)
    except ET.ParseError:
        return None
    if _local(root.tag) not in ("rss", "RDF", "feed"):
        return None
    out = []
    for node in root.iter():
        if _local(node.tag) not in ("item", "entry"):
            continue
        c = _children(node)
        text = lambda *names, c=c: next((("".join(c[n][0].itertext())).strip() for n in names if n in c and "".join(c[n][0].itertext()).strip()), None)
        links = c.get("link", [])
        href = next((x.get("href") for x in links if x.get("href") and x.get("rel", "alternate") == "alternate"), None)
        guid = text("guid", "id")
        out.append((text("title"), href or text("link") or guid, guid, text("encoded", "content", "description", "summary"), text("pubDate", "published", "date", "updated")))
    return out


def parse_feeds(bodies: DataFrame) -> DataFrame:
    """(feed, body) to items, a row each; bodies that are no feed give none."""

    def run(frames):
        for f in frames:
            rows = [(feed, *item) for feed, body in zip(f["feed"], f["body"], strict=True) for item in parse_feed(body) or []]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in ITEM.split(", ")])

    return bodies.select("feed", "body").mapInPandas(run, ITEM)
