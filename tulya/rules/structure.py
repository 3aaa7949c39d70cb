"""What tells the kind of a line."""

FOOTER = r"^[\s\-—–_]*(\d{1,3}|page\s*\d{1,3}|પાના\s*\d{1,3})[\s\-—–_]*$"
HEADINGS = [
    ("heading_1", r"^(?:નિર્ણય|આદેશ|આદેશસૂચિ|જાહેર સૂચના|સલામ|નમસ્કાર|વિગત|અરજી)\s*$", False),
    ("heading_1", r"^(?:vakalatnama|वकीलनामा|હવેલી|વકાલતનામું)$", True),
    ("case_number", r"^(?:SCC OnLine|S\.C\.C\.|AIR |\d+\s+SCC|\d+\s+AIR)\s", True),
]
COURT_NAME = r"(?:સર્વોચ્ચ\s+ન્યાયાલય|ઉચ્ચ\s+ન્યાયાલય|જિલ્લા\s+ન્યાયાલય|તાલુકા\s+ન્યાયાલય|કોર્ટ|ન્યાયાલય|ફોરમ)\b"
CASE_NUMBER = r"\b(?:CRL\.?\s*A\.?|CRA|R\.?\s*A\.?|C\.?\s?R\.?|C\.?\s?O\.?|S\.?\s?C\.?C\.?|O\.?\s?X?I{1,3})\s*(?:No\.?)?\s*\d+(?:\/\d{4})?"
CLAUSE = r"^\s*(\(?\d{1,3}(?:\.\d{1,3}){0,4}[.)]?|\(?[a-z]\)|\([ivx]+\)|[ivx]+\.)\s+"
SIGNATURE = r"(?:\(sd\/f\)|\bSD\/F\b|સહી\/સત્યકર|સહી|નોટરી|નોટરાઈઝ|સાધીનિ?\s*ધારના|સાધી|ખાસ\s*કામગીરી|\bDictated\b|\bTranscribed\b|\bCorrect\b|\bJUDGE\b|\bMember\s+Secretary\b|કલેક્ટર)"
SEAL = r"(?:court seal|ન્યાયાલય\s*છાપ|સિક્કા|છાપ|\(seal\)|\bstamp\b)"
CITATION = r"\b(?:Section|Article|Order|Rule|Schedule|Chapter|Part)\s+\d+|\b\d{1,3}\s+SCC\b|\b\d{1,3}\s+SCR\b|\bAIR\s+\d{4}\s+\w+"
LIST_ITEM = r"^[•\-*–—o]\s+"
QUOTE = r"^[\"“'']|[,:;.!?][\"“'']$"
#: Longest line of a kind.
MOST = {"footer": 100, "heading": 200, "case_number": 90, "seal_note": 80, "signature_block": 200, "citation": 160, "quotation": 400, "heading_2": 120, "court_name": 140}
#: A longer line is cut into pieces of this length.
DENSE = 900
#: Kinds that aren't translated.
NOT_TRANSLATED = ["footer", "header", "page_break", "seal_note"]
