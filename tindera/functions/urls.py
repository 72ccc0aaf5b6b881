"""Marketplace detection and canonical URLs.  Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marketplaces, the host each is known by, and its display name.
MARKETPLACES = {"shopee": ("shopee.ph", "Shopee PH"), "lazada": ("lazada.com.ph", "Lazada PH"), "temu": ("temu.com", "Temu PH")}
# Paths of the site that are no categories.
_BLOCKED = ("/user/", "/customer/", "/helpcenter/", "/cart")


def url_host(url: Column) -> Column:
    """Lower-case host without user and port; null unless the text is an http(s) URL."""
    authority = F.regexp_extract(F.trim(url), r"(?i)^https?://([^/?#]*)", 1)
    return F.nullif(F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")), F.lit(""))


#: A URL of one of the sites or of a host below it, whatever its user and port.
_SITE = r"(?i)^https?://(?:[^/?#]*@)?(?:[^/?#@]*\.)?(" + "|".join(site.replace(".", r"\.") for site, _ in MARKETPLACES.values()) + r")(?::[0-9]*)?(?:[/?#]|\z)"


def _market(url: Column) -> Column:
    """The marketplace whose site a URL is of, else null; one pattern for all, so that the URL is read once."""
    names = F.create_map(*[F.lit(x) for name, (site, _) in MARKETPLACES.items() for x in (site, name)])
    return F.try_element_at(names, F.lower(F.regexp_extract(F.trim(url), _SITE, 1)))


def marketplace(text: Column, default: str = "shopee") -> Column:
    """The marketplace of a URL or search text: plain text has the default; another site's URL is an error."""
    host = url_host(text)
    other = F.when(host.isNull(), default).otherwise(F.raise_error(F.concat(F.lit("unsupported marketplace: "), host)).cast("string"))
    return F.coalesce(_market(text), other)


def marketplace_or(text: Column, default: str = "shopee", other: str | None = None) -> Column:
    """The same without an error: another site's URL gives ``other``."""
    if other == default:
        return F.coalesce(_market(text), F.lit(other))
    return F.coalesce(_market(text), F.when(url_host(text).isNull(), default).otherwise(F.lit(other)))


def product_platform(platform: Column, link: Column) -> Column:
    """The stated platform if it is a known one, else that of the link, else shopee."""
    stated = F.lower(F.trim(platform))
    return F.coalesce(F.when(stated.isin(*MARKETPLACES), stated), marketplace_or(link, "shopee", "shopee"))


def platform_name(platform: Column) -> Column:
    shown = F.create_map(*[F.lit(x) for key, (_, name) in MARKETPLACES.items() for x in (key, name)])
    return F.coalesce(F.try_element_at(shown, platform), F.initcap(platform))


def _absolute(link: Column, site: str) -> Column:
    link = F.trim(link)
    return (
        F.when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.lit("https:"), link))
        .when(link.startswith("/"), F.concat(F.lit(f"https://{site}"), link))
        .otherwise(F.concat(F.lit(f"https://{site}/"), link))
    )


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def shopee_product_url(link: Column, site: str = "shopee.ph") -> Column:
    """Canonical URL, or empty: the very site, a product path, no query."""
    url = _absolute(link, site)
    good = (F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#]*)", 1)) == site) & _path(url).rlike(r"-i\.[0-9]+\.[0-9]+|/product/[0-9]+/[0-9]+")
    return F.when((link != "") & good, F.concat(F.lit(f"https://{site}"), _path(url))).otherwise("")


def _lazada_path(link: Column) -> Column:
    url = _absolute(link, "www.lazada.com.ph")
    path = F.regexp_replace(_path(url), r"/{2,}", "/")
    return F.when((link != "") & url_host(url).isin("lazada.com.ph", "www.lazada.com.ph"), path)


def lazada_product_url(link: Column) -> Column:
    path = _lazada_path(link)
    return F.when(path.contains("/products/") & F.lower(path).endswith(".html"), F.concat(F.lit("https://www.lazada.com.ph"), path)).otherwise("")


def lazada_category_url(link: Column) -> Column:
    """Canonical category URL with its query, without its fragment; empty for the root, products and account pages."""
    path = _lazada_path(link)
    low = F.lower(path)
    bad = (path == "/") | (path == "") | low.contains("/products/")
    for part in _BLOCKED:
        bad = bad | low.contains(part)
    query = _query(_absolute(link, "www.lazada.com.ph"))
    return F.when(~bad, F.concat(F.lit("https://www.lazada.com.ph"), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))).otherwise("")


def category_page_url(link: Column, page: Column) -> Column:
    """The category URL at a page: other filters stay, any ``page`` goes."""
    url = lazada_category_url(link)
    kept = F.filter(F.split(_query(url), "&"), lambda x: (x != "") & (F.lower(F.split_part(x, F.lit("="), F.lit(1))) != "page"))
    query = F.array_join(F.concat(kept, F.array(F.concat(F.lit("page="), F.greatest(F.lit(1), page).cast("string")))), "&")
    return F.when(url != "", F.concat(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("?"), query)).otherwise("")


def temu_product_url(link: Column) -> Column:
    """Canonical URL by goods id (from the query, else the path); empty without six digits of it."""
    url = _absolute(link, "www.temu.com")
    wanted = F.concat(F.lit("&"), _query(url))
    goods = F.regexp_extract(wanted, r"&goods_id=([^&]+)", 1)
    goods = F.when(goods != "", goods).otherwise(F.regexp_extract(_path(url), r"(?i)-g-([0-9]+)\.html(?:$|/)", 1))
    good = url_host(url).isin("temu.com", "www.temu.com", "m.temu.com") & goods.rlike(r"^[0-9]{6,}$")
    return F.when((link != "") & good, F.concat(F.lit("https://www.temu.com/goods.html?goods_id="), goods)).otherwise("")


def shopee_search_url(words: Column, page: Column, base: str = "https://shopee.ph") -> Column:
    return F.concat(F.lit(f"{base}/search?keyword="), F.url_encode(F.trim(words)), F.lit("&page="), F.greatest(F.lit(0), page).cast("string"), F.lit("&sortBy=sales"))


def lazada_search_url(words: Column, page: Column, base: str = "https://www.lazada.com.ph") -> Column:
    return F.concat(F.lit(f"{base}/catalog/?q="), F.url_encode(words), F.lit("&page="), F.greatest(F.lit(1), page).cast("string"))


def temu_search_url(words: Column, page: Column, base: str = "https://www.temu.com") -> Column:
    more = F.when(page > 1, F.concat(F.lit("&page="), page.cast("string"))).otherwise("")
    return F.concat(F.lit(f"{base}/ph-en/search_result.html?search_key="), F.url_encode(words), F.lit("&search_method=user&refer_page_el_sn=200010"), more)


def normalise_site(site: str) -> str:
    """The host a market name stands for; only the Philippine site is served."""
    if site.strip().lower().removeprefix("www.") in ("", "ph", "shopee.ph"):
        return "shopee.ph"
    raise ValueError(f"unsupported site {site!r}")
