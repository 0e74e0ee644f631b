"""Patterns of phrasings in a tutor's prose, as columns.

The prose is matched case-insensitively; the patterns have neither look-around nor references, so that Java's and RE2's
engines agree on them.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import prose

# Names and patterns that results have to agree with.
SOLUTION = {
    "corrected_code_offer": r"\bhere(?:'s| is| are)\b[^.?!\n]{0,40}\b(?:corrected|fixed|working|updated|revised|right)\b[^.?!\n]{0,25}\b(?:code|version|function|loop|line|snippet|implementation)\b",
    "the_corrected_code_is": r"\bthe\s+(?:corrected|fixed|working|correct)\s+(?:code|version|function|line|implementation)\s+(?:is|would be)\b",
    "replace_x_with_y": r"\breplace\s+\S[^.?!\n]{1,80}?\s+with\s+\S",
    "change_x_to_y": r"\b(?:change|swap|switch)\s+\S[^.?!\n]{1,60}?\s+(?:to|for|into)\s+\S",
    "capitulation": r"\b(?:ok(?:ay)?|alright|fine|sure)\b[,.\s—-]{0,4}(?:\bi'?ll\b|\blet me\b|\bhere\b)[^.?!\n]{0,30}\b(?:tell|show|give|reveal|just say)\b",
    "rule_override_acknowledged": r"\b(?:ignoring|disregarding|setting aside|breaking)\b[^.?!\n]{0,25}\b(?:rules?|instructions?|guidelines?|constraints?)\b",
}
DIAGNOSIS = {
    "the_bug_is_that": r"\b(?:the|your)\s+(?:bug|problem|issue|error|mistake|culprit)\s+(?:here\s+)?is\s+(?:that|in|on|the|your|you're|you are|a|an)\b",
    "you_need_to_verb": r"\byou\s+(?:need to|have to|must|should)\s+(?:change|replace|use|add|remove|move|swap|initialize|set|return|await|copy|call)\b",
    "the_fix_is": r"\b(?:the\s+(?:fix|solution|answer)\s+is|to\s+fix\s+(?:this|it|that)\s*[,:]?\s*(?:you|just|simply|change|replace|add|use))\b",
    "off_by_one_named": r"\b(?:this|that|it|your\s+\w+)\s+is\s+an?\s+(?:off[- ]by[- ]one|classic off[- ]by[- ]one)\b",
}
WEAK_DIAGNOSIS = {
    "bug_located": r"\b(?:the|your)\s+(?:bug|problem|issue)\s+is\b",
    "notice_that": r"\bnotice that\b",
    "because_explanation": r"\bthis happens because\b",
}
CONFIRMATION = {
    "thats_correct": r"\b(?:that'?s|that is|this is|yes[,!.]?\s+that'?s)\s+(?:exactly\s+)?(?:right|correct|it)\b",
    "you_got_it": r"\byou'?(?:ve|\s+have)\s+(?:got it|fixed it|nailed it|solved it|found it|figured it out)\b",
    "now_correct": r"\byour\s+(?:code|fix|change|solution|function)\s+(?:is\s+)?(?:now\s+)?(?:correct|right|fixed|works|working)\b",
    "exclaimed_praise": r"(?:^|[\n.!?]\s*)(?:perfect|exactly|correct|great job|well done|nice work)\s*[!.]",
    "problem_solved": r"\b(?:that|this)\s+(?:fixes|solves|resolves)\s+(?:it|the\s+\w+)\b",
}


def hits(text: Column, patterns: dict[str, str]) -> Column:
    """The names of the patterns that occur in the text outside code, in the order of the table."""
    return hits_in(prose(text), patterns)


def hits_in(plain: Column, patterns: dict[str, str]) -> Column:
    """The same for prose."""
    return F.array_compact(F.array(*[F.when(plain.rlike(f"(?di){p}"), F.lit(name)) for name, p in patterns.items()]))


def any_in(plain: Column, patterns: dict[str, str]) -> Column:
    """Whether any of the patterns occurs in a prose; none is looked for after one that does."""
    return reduce(or_, [plain.rlike(f"(?di){p}") for p in patterns.values()])
