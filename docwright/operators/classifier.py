"""Rule-based document classification: weighted patterns over the opening, the text, the file's stem and its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The kinds in the order in which ties are decided.
KINDS = (
    "witness_statement", "court_filing", "pleading", "skeleton_argument", "expert_report",
    "schedule_of_loss", "statute", "case_law", "contract", "email",
    "letter", "disclosure", "disclosure_list", "court_form", "case_management",
    "chronology", "medical_report", "tribunal_document", "regulatory_document",
)
#: Fixed values: (kind, scope, weight, pattern); the opening is the first 3000 characters, all are lower case.
RULES = (
    ("witness_statement", "start", 6, r"witness\s*statement"),
    ("witness_statement", "start", 5, r"i\s+make\s+this\s+statement"),
    ("witness_statement", "text", 5, r"statement\s+of\s+truth"),
    ("witness_statement", "text", 4, r"i\s+believe\s+(?:that\s+)?the\s+facts"),
    ("witness_statement", "text", 4, r"true\s+to\s+the\s+best\s+of\s+my\s+knowledge"),
    ("witness_statement", "start", 3, r"my\s+name\s+is\s+[a-z]+"),
    ("witness_statement", "start", 3, r"i\s+am\s+(?:employed|a\s+director|the\s+claimant)"),
    ("witness_statement", "stem", 4, r"ws[-_]?\d+|witness[-_]"),
    ("pleading", "start", 7, r"particulars\s+of\s+claim"),
    ("pleading", "start", 6, r"defence\s+(?:and\s+counterclaim)?"),
    ("pleading", "start", 6, r"reply\s+(?:to\s+)?defence"),
    ("pleading", "start", 5, r"counterclaim"),
    ("pleading", "start", 5, r"in\s+the\s+(?:high|county|commercial)\s+court"),
    ("pleading", "start", 4, r"claim\s*(?:no|number)[:\s]*\w+"),
    ("pleading", "start", 3, r"between[:\s]*\n"),
    ("pleading", "start", 3, r"(?:claimant|defendant|respondent|applicant)s?[:\s]*\n"),
    ("pleading", "stem", 4, r"(?:poc|defence|reply)[-_]"),
    ("pleading", "text", 2, r"(?:breach\s+of\s+)?(?:contract|duty|fiduciary)"),
    ("pleading", "text", 3, r"(?:fraud|deceit|misrepresentation|conspiracy)"),
    ("pleading", "text", 3, r"(?:unlawful\s+means|economic\s+tort)"),
    ("skeleton_argument", "start", 8, r"skeleton\s+argument"),
    ("skeleton_argument", "start", 6, r"submissions?\s+(?:on\s+behalf\s+of|for\s+the)"),
    ("skeleton_argument", "start", 5, r"written\s+submissions?"),
    ("skeleton_argument", "start", 4, r"(?:counsel|solicitors?)\s+for\s+the\s+(?:claimant|defendant)"),
    ("skeleton_argument", "stem", 5, r"skeleton[-_]"),
    ("skeleton_argument", "text", 4, r"it\s+is\s+(?:submitted|contended)"),
    ("skeleton_argument", "text", 3, r"the\s+(?:claimant|defendant)\s+(?:submits|contends)"),
    ("skeleton_argument", "text", 2, r"(?:ground|issue)\s+\d+"),
    ("expert_report", "start", 7, r"expert\s+(?:report|opinion|evidence)"),
    ("expert_report", "start", 5, r"(?:forensic|accounting|financial|medical|psychiatric|engineering)\s+expert"),
    ("expert_report", "text", 6, r"cpr\s+35|part\s+35"),
    ("expert_report", "text", 4, r"instructions?\s+to\s+(?:the\s+)?expert"),
    ("expert_report", "stem", 4, r"expert[-_]|report[-_]expert"),
    ("expert_report", "start", 4, r"my\s+(?:qualifications?|expertise|experience)"),
    ("expert_report", "text", 4, r"(?:jointly|single|joint)\s+instructed"),
    ("expert_report", "start", 3, r"i\s+(?:am|have\s+been)\s+(?:instructed|asked)"),
    ("expert_report", "text", 2, r"(?:appendix|annex|schedule)\s+[a-z0-9]+[:\s]"),
    ("schedule_of_loss", "start", 8, r"schedule\s+of\s+(?:loss|damage|losses)"),
    ("schedule_of_loss", "start", 6, r"quantum\s+(?:of\s+)?(?:claim|damages)"),
    ("schedule_of_loss", "start", 6, r"(?:counter[-\s]?schedule|counter\s+schedule)"),
    ("schedule_of_loss", "text", 4, r"(?:principal|interest|total)\s+claimed"),
    ("schedule_of_loss", "text", 3, r"loss\s+of\s+(?:profit|earnings|income)"),
    ("schedule_of_loss", "text", 3, r"(?:special|general|consequential)\s+damages?"),
    ("schedule_of_loss", "stem", 4, r"schedule[-_]|sol[-_]"),
    ("schedule_of_loss", "text", 2, r"[\$£€]\s*[\d,]+(?:\.\d{2})?"),
    ("court_filing", "start", 7, r"(?:it\s+is|the\s+court)\s+(?:hereby\s+)?order(?:ed|s)"),
    ("court_filing", "start", 6, r"judgment\s+(?:of|in|dated)"),
    ("court_filing", "start", 5, r"upon\s+(?:reading|hearing|consideration)"),
    ("court_filing", "start", 5, r"before\s+(?:the\s+)?(?:honourable|hon\.?)\s+(?:mr\s+)?justice"),
    ("court_filing", "text", 5, r"sealed\s+(?:by\s+)?(?:the\s+)?court"),
    ("court_filing", "stem", 4, r"(?:order|judgment|ruling|directions?)[-_]"),
    ("court_filing", "text", 3, r"dated\s+this\s+\d+"),
    ("court_filing", "text", 4, r"(?:peremptory|unless)\s+order"),
    ("court_filing", "text", 3, r"costs?\s+(?:in\s+the\s+case|reserved|summarily)"),
    ("statute", "start", 7, r"an\s+act\s+to\s+(?:amend|provide|make)"),
    ("statute", "start", 7, r"be\s+it\s+(?:enacted|resolved)"),
    ("statute", "start", 5, r"(?:act|regulation)\s+\d{4}"),
    ("statute", "text", 5, r"section\s+\d+\s*\(\d+\)"),
    ("statute", "text", 3, r"(?:subsection|paragraph|subparagraph)"),
    ("statute", "start", 3, r"(?:commencement|interpretation|extent)\s+(?:and\s+)?(?:application)?"),
    ("statute", "stem", 4, r"statute|legislation|_act[-_]"),
    ("statute", "text", 5, r"(?:enterprise\s+act|competition\s+act|fraud\s+act|companies\s+act)"),
    ("case_law", "start", 8, r"\[\d{4}\]\s+(?:ewca|ewhc|uksc|ukhl)"),
    ("case_law", "start", 6, r"(?:v\s+|versus\s+).{2,50}?\[\d{4}\]"),
    ("case_law", "start", 6, r"approved\s+judgment"),
    ("case_law", "text", 4, r"(?:lord|lady)\s+justice\s+[a-z]+"),
    ("case_law", "text", 2, r"(?:para(?:graph)?s?\s+)?\[\d+\]"),
    ("case_law", "start", 4, r"(?:claimant|appellant)\s+(?:v|versus)\s+"),
    ("case_law", "stem", 4, r"case[-_]?law|judgment[-_]"),
    ("contract", "start", 5, r"this\s+(?:agreement|contract|deed)"),
    ("contract", "start", 4, r"(?:parties?\s+)?(?:hereby\s+)?agree(?:s|d)?"),
    ("contract", "start", 4, r"(?:whereas|recitals?|background)"),
    ("contract", "text", 4, r"(?:now\s+)?(?:therefore|it\s+is\s+agreed)"),
    ("contract", "text", 5, r"in\s+witness\s+whereof"),
    ("contract", "text", 5, r"executed\s+(?:as\s+)?a?\s*deed"),
    ("contract", "text", 2, r"(?:obligations?|warranties|representations?|covenants?)"),
    ("contract", "text", 2, r"(?:termination|governing\s+law|jurisdiction)"),
    ("contract", "stem", 4, r"(?:contract|agreement|deed|nda|mou|sla)[-_]"),
    ("contract", "text", 2, r"(?:schedule|exhibit|annex)\s+\d+"),
    ("email", "start", 5, r"from:\s*[^\n]+"),
    ("email", "start", 4, r"to:\s*[^\n]+"),
    ("email", "start", 4, r"subject:\s*[^\n]+"),
    ("email", "start", 3, r"(?:sent|date):\s*\d+"),
    ("email", "start", 3, r"cc:\s*[^\n]+"),
    ("email", "path", 6, r"\.eml$|\.msg$"),
    ("email", "stem", 3, r"email[-_]|mail[-_]"),
    ("email", "text", 5, r"-----\s*original\s+message\s*-----"),
    ("email", "start", 2, r"@[a-z0-9]+\.[a-z]{2,}"),
    ("letter", "start", 5, r"(?:dear\s+(?:sir|madam|mr|mrs|ms|sirs))"),
    ("letter", "text", 5, r"yours\s+(?:faithfully|sincerely)"),
    ("letter", "start", 4, r"(?:without\s+prejudice|strictly\s+confidential)"),
    ("letter", "start", 3, r"we\s+(?:write|refer|act)\s+(?:to|for|on)"),
    ("letter", "start", 3, r"(?:solicitors?|counsel)\s+for"),
    ("letter", "stem", 3, r"letter[-_]|correspondence[-_]"),
    ("letter", "start", 2, r"re:\s+[^\n]+"),
    ("letter", "start", 3, r"(?:our|your)\s+(?:ref|reference)[:\s]"),
    ("disclosure", "start", 4, r"(?:exhibit|annex)\s+[a-z0-9]+"),
    ("disclosure", "start", 5, r"this\s+is\s+(?:the\s+)?exhibit"),
    ("disclosure", "stem", 4, r"disclosure[-_]|exhibit[-_]|bundle[-_]"),
    ("disclosure", "text", 4, r"paginated\s+bundle"),
    ("disclosure", "text", 3, r"(?:document|page)\s+\d+\s+of\s+\d+"),
    ("disclosure_list", "start", 7, r"list\s+of\s+documents?"),
    ("disclosure_list", "start", 8, r"form\s+n\s*265"),
    ("disclosure_list", "start", 5, r"(?:standard|specific)\s+disclosure"),
    ("disclosure_list", "text", 3, r"(?:inspection|copies?)\s+(?:of\s+)?documents?"),
    ("disclosure_list", "stem", 5, r"disclosure[-_]list|n265"),
    ("disclosure_list", "start", 3, r"part\s+[12]\s*[:\s]"),
    ("court_form", "start", 7, r"form\s+n\s*\d+"),
    ("court_form", "start", 6, r"(?:n1|n260|n244|n170|n180|n9)"),
    ("court_form", "start", 5, r"(?:claim\s+form|application\s+notice)"),
    ("court_form", "start", 5, r"(?:allocation\s+questionnaire|directions\s+questionnaire)"),
    ("court_form", "stem", 5, r"form[-_]n\d+|n\d+[-_]"),
    ("case_management", "start", 7, r"(?:case|costs?)\s+management\s+(?:conference|order|directions)"),
    ("case_management", "start", 5, r"directions?\s+order"),
    ("case_management", "start", 5, r"pre[-\s]?trial\s+(?:review|checklist|timetable)"),
    ("case_management", "start", 4, r"(?:agreed\s+)?(?:directions|timetable)"),
    ("case_management", "stem", 4, r"cmc[-_]|ptc[-_]|directions[-_]"),
    ("case_management", "text", 3, r"(?:disclosure|witness\s+statements?|expert)\s+by\s+\d+"),
    ("chronology", "start", 8, r"chronology"),
    ("chronology", "start", 4, r"(?:agreed\s+)?(?:statement\s+of\s+)?(?:facts?\s+and\s+)?issues?"),
    ("chronology", "start", 5, r"(?:date|period|time)[:\s]+(?:event|description|fact)"),
    ("chronology", "stem", 5, r"chronology[-_]|timeline[-_]"),
    ("chronology", "text", 3, r"\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}[:\s]+"),
    ("medical_report", "start", 7, r"(?:medical|medico[-\s]?legal)\s+report"),
    ("medical_report", "text", 3, r"(?:diagnosis|prognosis|treatment|history)"),
    ("medical_report", "text", 3, r"(?:gp|consultant|doctor|surgeon|psychiatrist|psychologist)"),
    ("medical_report", "text", 2, r"(?:injury|injuries|condition|symptoms)"),
    ("medical_report", "stem", 4, r"medical[-_]|medico[-_]"),
    ("medical_report", "text", 3, r"(?:examination|assessment)\s+(?:on|dated)"),
    ("tribunal_document", "start", 7, r"(?:employment|competition)\s+(?:tribunal|appeal\s+tribunal)"),
    ("tribunal_document", "start", 6, r"(?:cat|eat|et)\s+case\s+(?:no|number)"),
    ("tribunal_document", "text", 5, r"competition\s+(?:and\s+markets?\s+)?authority|cma"),
    ("tribunal_document", "start", 5, r"(?:tribunal|appeal)\s+(?:judgment|decision|ruling)"),
    ("tribunal_document", "stem", 4, r"tribunal[-_]|cat[-_]|eat[-_]"),
    ("regulatory_document", "start", 6, r"(?:fca|pra|sra|ofcom|ofgem)\s+(?:decision|finding|notice)"),
    ("regulatory_document", "start", 5, r"(?:regulatory|enforcement)\s+(?:notice|action|decision)"),
    ("regulatory_document", "start", 4, r"(?:investigation|enforcement)\s+(?:report|summary)"),
    ("regulatory_document", "text", 4, r"(?:breach|contravention)\s+of\s+(?:rule|regulation)"),
    ("regulatory_document", "stem", 4, r"regulatory[-_]|fca[-_]|enforcement[-_]"),
)
#: Fixed values: (kind, scope, pattern, more matches than, weight).
COUNTED = (
    ("witness_statement", "start", r"\bi\s+(?:am|was|have|had|will|would|believe|saw|heard|know|met|spoke)", 8, 3),
    ("pleading", "text", r"(?m)^\s*\d+\.\s+", 10, 2),
)
OPENING, LEAST, FULL, OTHERWISE = 3000, 3, 25, "disclosure"


def needles(pattern: str) -> list[str] | None:
    """Literals of which every match holds one, as long as can be; None where no literal is sure."""
    from re import _constants as C, _parser

    def best(found: list) -> list[str] | None:
        sure = [f for f in found if f]
        return max(sure, key=lambda f: min(map(len, f))) if sure else None

    def walk(items) -> list[str] | None:
        found, run = [], ""
        for op, value in [*items, (None, None)]:
            if op is C.LITERAL:
                run += chr(value)
                continue
            if run:
                found.append([run])
                run = ""
            if op is C.SUBPATTERN:
                found.append(walk(value[3]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] > 0:
                found.append(walk(value[2]))
            elif op is C.BRANCH:
                parts = [walk(b) for b in value[1]]
                found.append([n for part in parts for n in part] if all(parts) else None)
        return best(found)

    return walk(_parser.parse(pattern))


def holds(text: Column, pattern: str) -> Column:
    """Whether the pattern is found; its literals are looked for first, which spares most texts the pattern."""
    sure = needles(pattern)
    if not sure or min(map(len, sure)) < 2 or len(sure) > 12:
        return text.rlike(pattern)
    some = F.contains(text, F.lit(sure[0]))
    for n in sure[1:]:
        some = some | F.contains(text, F.lit(n))
    return some & text.rlike(pattern)


def classified(docs: DataFrame, id_col: str, text_col: str, path: Column) -> DataFrame:
    """(id, kind, score, confidence): the kind with the largest sum of weights, the first in KINDS on a tie; under LEAST it is OTHERWISE with 0.2.

    One scan with built-in functions; a null text or path is empty.
    """
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    file = F.lower(F.coalesce(path, F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.substring(text, 1, OPENING).alias("start"), file.alias("path"),
                       F.regexp_replace(F.substring_index(file, "/", -1), r"(?<=.)\.[^.]*$", "").alias("stem"))

    def score(kind: str) -> Column:
        parts = [F.when(holds(F.col(scope), pattern), weight).otherwise(0) for k, scope, weight, pattern in RULES if k == kind]
        parts += [F.when(F.regexp_count(scope, F.lit(pattern)) > more, weight).otherwise(0) for k, scope, pattern, more, weight in COUNTED if k == kind]
        return sum(parts[1:], parts[0])

    every = F.array(*[F.struct(score(k).alias("score"), F.lit(-n).alias("order"), F.lit(k).alias("kind")) for n, k in enumerate(KINDS)])
    best = rows.select("id", F.array_max(every).alias("best"))
    sure = F.col("best.score") >= LEAST
    return best.select("id", F.when(sure, F.col("best.kind")).otherwise(OTHERWISE).alias("kind"), F.col("best.score").alias("score"),
                       F.when(sure, F.least(F.col("best.score") / FULL, F.lit(1.0))).otherwise(0.2).alias("confidence"))
