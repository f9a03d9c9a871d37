"""Whole numbers in English words."""

from __future__ import annotations

# Names of numbers and the parts from which names of large ones are put together.
SMALL = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
FIRST = ("thousand", *(x + "illion" for x in "m b tr quadr quint sext sept oct non".split()))
UNIT_PARTS = ("", *"un duo tre quattuor quin sex sept octo novem".split())
TEN_PARTS = "dec vigint trigint quadragint quinquagint sexagint septuagint octogint nonagint cent".split()

#: Longer runs of digits are spelled in parts of this length.
PART = 306
NEW_TAI_LUE = range(0x19D0, 0x19DA)


def scale(power: int) -> str:
    """The name of 1000 ** power."""
    if power < len(FIRST) + 1:
        return FIRST[power - 1]
    tens, units = divmod(power - 1, 10)
    return UNIT_PARTS[units] + TEN_PARTS[tens - 1] + "illion"


def below_thousand(n: int) -> str:
    hundreds, rest = divmod(n, 100)
    parts = [f"{SMALL[hundreds]} hundred"] if hundreds else []
    if rest or not hundreds:
        tens, units = divmod(rest, 10)
        parts.append(SMALL[rest] if rest < 20 else TENS[tens - 2] + (f"-{SMALL[units]}" if units else ""))
    return " and ".join(parts)


def number_words(n: int) -> str:
    """n in words: groups of thousands are parted by commas, a last group below a hundred follows 'and'."""
    if n < 0:
        return "minus " + number_words(-n)
    groups = []
    rest, power = n, 0
    while rest or not groups:
        rest, group = divmod(rest, 1000)
        groups.append((power, group))
        power += 1
    words = [below_thousand(g) + (f" {scale(p)}" if p else "") for p, g in reversed(groups) if g or n == 0]
    if len(words) > 1 and 0 < groups[0][1] < 100:
        return ", ".join(words[:-1]) + " and " + words[-1]
    return ", ".join(words)


def spell_numbers(text: str) -> str:
    """text with its digit words spelled out; words with digits of New Tai Lue vanish, very long numbers go in parts."""
    words = []
    for word in text.split():
        if word.isdigit() and any(ord(c) in NEW_TAI_LUE for c in word):
            continue
        if word.isdecimal():
            parts = [word] if len(word) <= PART else [word[i : i + PART] for i in range(0, len(word), PART)]
            word = " ".join(number_words(int(p)) for p in parts)
        words.append(word)
    return " ".join(words)
