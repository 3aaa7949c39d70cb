"""Fixed values of the offline renderer: common words, months, and what it leaves as it is."""

COMMON = {
    "અને": "and", "છે": "is", "છો": "are", "હતું": "was", "હતી": "was", "હશે": "will be",
    "આ": "this", "આ પ્રકરણના": "in this matter", "ના": "of", "ની": "of", "નું": "'s", "ને": "to", "થી": "from",
    "માટે": "in respect of", "સાથે": "with", "પર": "upon", "કરે": "does", "કરવા": "to do", "કરી": "did",
    "હોય": "may be", "થાય": "may happen", "છું": "am", "છીએ": "are", "હવે": "now", "આજે": "today",
    "તારીખે": "on", "દિવસી": "on the day", "અધિકારી": "officer", "વિભાગ": "Department",
    "જે": "which", "કે": "that", "જે પ્રમાણે": "as provided", "નોંધ": "record", "રજિસ્ટર": "register",
    "રજિસ્ટરી": "registry", "કામગીરી": "copy", "નકલ": "copy", "પ્રમાણિત": "certified",
    "માન્ય": "valid", "વૈધ": "valid", "અવૈધ": "invalid", "કાયમી": "permanent", "અંતર્ગત": "interim",
    "તાત્કાલિક": "immediate", "તાત્કાલિકી": "immediately", "વખતે": "at the time", "સમયે": "at the time",
    "કેમકે": "because", "કારણકે": "since", "જો": "if", "તો": "then", "અથવા": "or", "કેમ કે": "whether",
    "અસમર્થ": "unnecessary", "જરૂરી": "necessary", "જરૂર": "necessary", "વધુ": "more", "ઓછું": "less",
    "સમગ્ર": "entire", "કુલ": "total", "દરેક": "each", "બધા": "all",
    "ઉપરોક્ત": "aforesaid", "અગાઉ": "earlier", "ઉપર": "above", "નીચે": "below", "પછી": "after",
    "પહેલા": "before", "અત્યાર": "now", "ત્યારે": "then", "હાજર": "present", "ગેરહાજર": "absent",
    "મોટા": "large", "નાના": "small", "તે": "he", "તેઓ": "they", "તેને": "him",
    "અમુક": "free", "વ્યવસ્થા": "arrangement", "સૂચના": "information", "જાણ": "knowledge",
    "કાર્ય": "work", "કાર્યક્રમ": "proceedings", "કાર્યવાહી": "proceedings",
    "સમજોટા": "settlement", "નોંધણી": "registration", "હસ્તક્ષર": "signature",
    "નિવારણા": "remedy", "રાહ": "relief", "વિનંતી": "prayer", "યાદ": "record",
    "સ્થાન": "place", "તા": "of",
    "તેઓને": "them", "તેની": "her", "તેમને": "them", "જેમ": "as", "જ્યારે": "when",
    "જોઈએ": "if required", "લાગી": "applicable", "લાગુ": "applicable",
    "સમાન": "common", "અલગ": "different", "નવીન": "new", "જૂની": "old",
}

MONTHS = {
    "જાન્યુઆરી": "January", "ફેબ્રુઆરી": "February", "માર્ચ": "March", "એપ્રિલ": "April", "એપ્રીલ": "April", "મે": "May",
    "જૂન": "June", "જુન": "June", "જુલાઈ": "July", "જુલાઇ": "July", "ઑગસ્ટ": "August", "ઓગસ્ટ": "August",
    "સપ્ટેમ્બર": "September", "સપ્ટેંબર": "September", "ઑક્ટોબર": "October", "ઓક્ટોબર": "October",
    "નવેમ્બર": "November", "નવેંબર": "November", "ડિસેમ્બર": "December", "ડિસેંબર": "December",
}

#: Facts that stay as they are, in this order; the second says whether case counts.
KEPT = [
    (r"[₹]?\s*\bRs\.?\s*[\d૦-૯][\d,૦-૯.\s]*", True),
    (r"\b[\d૦-૯]{1,2}[-/.]\s*[\d૦-૯]{1,2}[-/.]\s*[\d૦-૯]{2,4}\b", True),
    (r"\b(?:Section|Article|Order|Rule|Schedule|Chapter|Part|Clause)\s*[\d૦-૯]+", False),
    (r"\b(?:IPC|BNS|CrPC|BNSS|CPC|IEA|BSA|NI\s*Act|SARFAESI|PMLA|POCSO|NDPS)\b", True),
    (r"\b(?:[A-Z]{1,4}\.?\s*){1,4}(?:No\.?\.?\s*)?\d+\/\d{2,4}\b", True),
    (r"\b[\d૦-૯]{3,}\b", True),
]

#: Confidence of a rendered segment, and of one with much residue; the share of residue that is much.
CONFIDENCE, LOW_CONFIDENCE, MUCH_RESIDUE = 0.72, 0.55, 0.15
