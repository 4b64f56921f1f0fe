"""Column expressions: URLs, text, vectors."""

from lodestone.functions.text import clean_html, collapse_blank_lines, hrefs, sentences, token_windows, tokens
from lodestone.functions.urls import has_asset_suffix, is_page, normal_url, origin, slug, url_path
from lodestone.functions.vectors import cosine, dot, norm

__all__ = ["clean_html", "collapse_blank_lines", "cosine", "dot", "has_asset_suffix", "hrefs", "is_page", "norm", "normal_url", "origin", "sentences", "slug", "token_windows", "tokens", "url_path"]
