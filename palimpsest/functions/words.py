"""Word lists and patterns that results depend on, in one place."""

from __future__ import annotations

#: The agent's own name, which names nobody else.
AGENT = "Tessel"

# Words that don't count in a keyword query.
QUERY_STOP = """
a an the of to in on for and or is are was were be been it its this that what which who whom whose when where why how do does did i you he she we they me my your our their with at by from
as about into than then there here have has had not no yes can could would should will shall may might
""".split()

# Capitalised words that are no names.
NAME_STOP = """
I The A An And But Or So If When Then This That These Those It Its He She They We You Yes No Ok Okay Sure Thanks Hi Hello My Our Your Their His Her Also Just Please Let What Which Who Where Why How
Is Are Was Were Do Does Did Can Could Would Should Will Here There Today Tomorrow Yesterday Monday Tuesday Wednesday Thursday Friday Saturday Sunday
January February March April May June July August September October November December USER ASSISTANT Note
""".split()
# Forms of names: capitalised words in a row, capitals, and words with inner capitals or digits.
NAMES = r"\b(?:[A-Z][a-z]+(?:[ -][A-Z][a-zA-Z0-9]+)*|[A-Z]{2,}[a-z]*|[A-Z][a-z]*[A-Z0-9][A-Za-z0-9-]*)\b"

# How a line begins that answers the one before, or points back to it.
ASSENT = (
    r"(?i)^\s*(?:yes|yeah|yep|yup|sure|ok|okay|no|nope|nah|do it|go ahead|sounds good|agreed|please do|let'?s do (?:it|that)|that works|perfect|correct|right|exactly|both|neither"
    r"|the (?:first|second|third|last) one)\b"
)
POINTING = r"(?i)^\s*(?:it|its|it's|they|them|their|this|that|these|those|he|she|his|her|him|there|then|same|which|the one|so)\b"
# A question that goes on from the one before.
FOLLOW_UP = r"(?i)^\s*(?:and|also|what about|how about|so what|then)\b|\b(?:it|this|those|these|them|the other(?: one)?|that one|the same|again)\b"

# Words by which a question asks for a type of value.
HINTS = {
    "time": r"(?i)\b(when|what time|what date|which day|how long ago)\b",
    "money": r"(?i)\b(how much|cost|price|paid|spend|spent|budget)\b",
    "duration": r"(?i)\b(how long|duration)\b",
    "quantity": r"(?i)\b(how many|how far|how big|how heavy|how tall)\b",
    "contact": r"(?i)\b(link|url|website|email|phone|number for)\b",
    "artifact": r"(?i)\b(command|path|file|version|ticket|script)\b",
}

# What a question asks of the agent.
ASKS_ADVICE = r"(?i)\b(?:suggest|suggestions?|recommend|recommendations?|advice|tips?|ideas?|what should I|should I|help me (?:choose|pick|find|decide|plan)|any (?:thoughts|pointers))\b"
ASKS_AGENT = (
    r"(?i)\b(?:you|you've|you had)\s+(?:said|told|recommended|suggested|mentioned|gave|wrote|listed|proposed|explained|described|shared|provided|came up with)\b"
    r"|\bdid you\s+(?:say|tell|recommend|suggest|mention|give|list)\b|\byour\s+(?:answer|suggestions?|recommendations?|advice|list|reply|explanation)\b"
)


def sql(pattern: str) -> str:
    """A pattern or word as the inside of an SQL string."""
    return pattern.replace("'", "''")
