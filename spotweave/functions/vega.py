"""Vega-Lite charts and HTML pages from small tables."""

from __future__ import annotations

import html
import json


def chart(rows: list[dict], mark: str, title: str, width: int = 350, height: int = 250, **encoding) -> dict:
    """A chart of rows; encoding: channel = "field:type" or a dict."""
    channels = {c: {"field": e.rpartition(":")[0], "type": {"Q": "quantitative", "N": "nominal", "O": "ordinal"}[e[-1]]} if isinstance(e, str) else e for c, e in encoding.items()}
    return {"$schema": "https://vega.github.io/schema/vega-lite/v5.json", "title": title, "width": width, "height": height, "data": {"values": rows}, "mark": mark, "encoding": channels}


def page(title: str, charts: dict[str, dict], text: str = "") -> str:
    """An HTML page; scripts come from where the reader's browser finds Vega."""
    head = "".join(f'<script src="https://cdn.jsdelivr.net/npm/{p}"></script>' for p in ("vega@5", "vega-lite@5", "vega-embed@6"))
    body = "".join(f'<div id="{k}"></div><script>vegaEmbed("#{k}", {json.dumps(c)});</script>' for k, c in charts.items())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title>{head}</head><body><h1>{html.escape(title)}</h1>{text}{body}</body></html>"
