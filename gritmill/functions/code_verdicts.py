"""Verdicts on findings by the code around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What suspends or defers code in JavaScript, and what switches escaping off in templates.
SUSPENDS = r"\b(?:await|yield|Promise|setTimeout|setInterval|setImmediate|nextTick|queueMicrotask|Worker)\b|\.(?:then|catch|finally|on|once)\s*\(|\basync\b"
RAW_OUTPUT = r"(?i)\|\s*safe\b|\braw\s*\(|\bhtml_safe\b|\{\{\{|<%-|\{!!|v-html|dangerouslySetInnerHTML|innerHTML|autoescape\s+(?:off|false)|Markup\("
ESCAPED_OUTPUT = r"\{\{[^{}]+\}\}|<%=[^%]+%>"
DANGEROUS_PLACE = r"(?i)<script\b|<style\b|\bon\w+\s*=|\b(?:href|src|action|style)\s*=\s*[\"']?\s*(?:\{\{|<%=)"


def synchronous_race(file: Column, vuln_class: Column, window: Column) -> Column:
    """A race claimed in JavaScript or TypeScript code that can't be suspended; a blank window proves nothing."""
    script = F.lower(file).rlike(r"\.(?:m?js|cjs|jsx|tsx?)$")
    return F.coalesce(script & (vuln_class == "race-condition") & window.rlike(r"\S") & ~window.rlike(SUSPENDS), F.lit(False))


def autoescaped(file: Column, cwe_number: Column, window: Column) -> Column:
    """Script injection claimed in an escaping template whose window only prints escaped values in safe places."""
    template = F.lower(file).rlike(r"\.(?:html|htm|jinja2?|j2|twig|erb|ejs|hbs|vue|liquid)$")
    safe = window.rlike(ESCAPED_OUTPUT) & ~window.rlike(RAW_OUTPUT) & ~window.rlike(DANGEROUS_PLACE)
    return F.coalesce(template & cwe_number.isin(79, 80) & safe, F.lit(False))
