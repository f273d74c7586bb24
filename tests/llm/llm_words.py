"""Both word rules, in plain Python."""

import re

LOWER = {k: k + 32 for k in range(65, 91)}


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alphanumeric(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
