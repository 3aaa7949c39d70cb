"""What tells a document's type. Type, weight of a hit, patterns (i: any case)."""

RULES = [
    ("court_judgment", 3, [
        (r"\bSCC\s*OnLine", "i"), (r"\b(?:CRL\.?\s*A\.?|C\.?\s?R\.?|CRA)\s*\d+\/\d{4}", "i"), (r"\b(?:MANU|LD)\s*\d+", "i"),
        (r"નિર્ણય", ""), (r"નિર્ણયની", ""), (r"\bCORAM\b", "i"), (r"\bJUDGMENT\b", "i"),
        (r"\b(?:HON'?ABLE|J)\s*:?\s*(?:JUSTICE|JUDGE)", "i"), (r"\b(?:PLAINTIFF|APPELLANT)\s+VERSUS\b", "i"),
        (r"\b(?:before|Judgment delivered by)\b", "i"), (r"સામરે", ""), (r"સામરેથી", ""),
        (r"\b(?:Considering|It is ordered|Ordered that)\b", "i"),
        (r"\b(?:appeal|Revision) (?:is )?(?:allowed|dismissed|partly allowed)", "i"), (r"આદેશ થયો", ""), (r"નિર્ણયાર્થ", ""),
        (r"\b(?:accused|Petitioner)\s+(?:is|was)\s+(?:acquitted|convicted|discharged)", "i"),
    ]),
    ("court_order", 2, [
        (r"\bC\.?O\.?\s*No\.?\s*\d+\/\d{4}", "i"), (r"\bOrder No\.?\s*\d+", "i"), (r"\b(?:on|dated)\s+\d{1,2}\/\d{1,2}\/\d{4}", "i"),
        (r"આદેશ", ""), (r"\b(?:interim order|stay order|vacate order)\b", "i"), (r"\bIt is ordered\b", "i"),
        (r"\b(?:learned|learnt) (?:Advocate|APP)\b", "i"), (r"અરજી(?:નો)? નિરાખ", ""), (r"\bPetition(?:er)?\s+prays\b", "i"),
    ]),
    ("legal_notice", 3, [
        (r"વૈધ નોટિસ", "i"), (r"\b(?:LEGAL|legal)\s+NOTICE\b", "i"), (r"નોટિસ", ""),
        (r"\bunder my instructions and on behalf of\b", "i"), (r"\bhereby (?:give|call|serve|put) you on notice\b", "i"),
        (r"\byou are hereby (?:called|required|put) on notice\b", "i"), (r"\bwithin (\d+|seven|fifteen|thirty) days\b", "i"),
        (r"\b(?:take note|be informed) that\b", "i"),
        (r"\b(?:advocate|Advocate) (?:for|on behalf of) the (?:complainant|defendant|petitioner)\b", "i"),
        (r"\bAll correspondence to be addressed to\b", "i"), (r"સલામ", ""), (r"નમસ્કાર", ""),
    ]),
    ("fir_document", 4, [
        (r"ફરિયાદ\s*(?:નોંધણી|નોંધણી\s*પત્ર|કોપી)?", ""), (r"\bFIR\s*(?:No\.?|Number|book|entry)?", "i"),
        (r"\bFirst Information Report\b", "i"), (r"\b(?:Daily Diary|Station Diary|Diary No\.)\b", "i"),
        (r"\bGD No\.|\bGeneral Diary\b", "i"), (r"\b(?:s\/\d{4}|R\/No\.)\b", "i"), (r"\bPolice Station\b", ""),
        (r"\bStation House Officer\b", "i"), (r"\bInformant\b", "i"), (r"\b(?:Sections?)\s*\d+[A-Z]?\s*(?:IPC|BNS)\b", "i"),
        (r"\bSchedule of Offences\b", "i"),
    ]),
    ("police_report", 3, [
        (r"\b(?:charge[- ]?sheet|chargesheet)\b", "i"), (r"\b(?:investigation report|final report|report under Section)\b", "i"),
        (r"\b(?:arrest(?:ing)? memo|arrest memo)\b", "i"), (r"\b(?:remand|remand memo)\b", "i"),
        (r"\b(?:custody record|undertrial|convict|prisoner)\b", "i"),
        (r"\bFIR (?:copy|extract) (?:is )?(?:received|received at)\b", "i"), (r"\bSDO\b|\bI\.O\.P\.B\.?\b", ""),
        (r"ચાર્જશીટ", ""), (r"ધરાવ", ""), (r"જપ્ત", ""), (r"તપાસ", ""),
    ]),
    ("government_order", 2, [
        (r"\b(?:Government of (?:Gujarat|India))\b", "i"), (r"\b(?:GR|G\.R\.) (?:No\.?)?\s*\d+\/\d{2,4}[-/]\s*\d+\b", "i"),
        (r"\b(?:Circular|Office Order|Government Order|Resolution)\b", "i"), (r"\b(?:Government Notification) No\.?\s*\d+", "i"),
        (r"\b(?:Collector|District Collector|Secretary)\b", "i"), (r"\b(?:Finance|Home|Revenue|Transport)\s+Department\b", "i"),
        (r"શાસન", ""), (r"ગામભાત", ""), (r"\b(?:hereby|is hereby)\s+(?:directed|instructed)\b", "i"),
    ]),
    ("agreement", 2, [
        (r"\b(?:Settlement Deed|Reconciliation|MOU|Memorandum of Understanding)\b", "i"),
        (r"\b(?:this deed|this agreement) is made\b", "i"), (r"\b(?:Whereas|Whereas and Whereas)\b", "i"),
        (r"\bin consideration of\b", "i"), (r"\b(?:lessor|lessee|tenant)(?: shall)? (?:agrees|agrees to)\b", "i"),
        (r"\b1\. THIS DEED\b", "i"), (r"\b(?:first party|second party)\b", "i"), (r"સમજોટા", ""), (r"કરાર", ""),
        (r"વાસમાં આપેલ", ""), (r"અહેવાલી", ""),
    ]),
    ("contract", 2, [
        (r"\b(?:purchase agreement|supply agreement|service agreement)\b", "i"),
        (r"\b(?:terms and conditions|force majeure|indemnity|warranty)\b", "i"), (r"\b(?:bill of supply|purchase order)\b", "i"),
        (r"\bperformance guarantee\b", "i"), (r"વ્યવસાય", ""), (r"શરતો", ""), (r"પ્રમાણ ચૂકવો", ""),
    ]),
    ("property_document", 3, [
        (r"\b(?:sale deed|conveyance deed|conveyance)\b", "i"), (r"\b(?:7\/12|8-A|8A)\b", ""),
        (r"\b(?:Record of Rights|khata|khatauni|khunwari)\b", "i"), (r"\b(?:mortgage deed|equitable mortgage|charge)\b", "i"),
        (r"\b(?:lease deed|licence|tenancy)\b", "i"), (r"\b(?:survey number|block number|tp\s*\d+|survey\s*(?:no|number))\b", "i"),
        (r"\b(?:plot(?:s)?\s*(?:no|number)|shikren)\b", "i"), (r"\b(?:adhesion|adhésion) stamp\b", "i"), (r"વેચાણ પત્ર", ""),
        (r"ખરીદી કાગળ", ""), (r"અસલ કામગીરી", ""), (r"સત્તાવિહી", ""), (r"હિસ્સેદાર", ""), (r"આભાઈ", ""),
        (r"પ્રકાર[:ઃ]?\s*વેચા", ""), (r"નોંધણી ફી", ""), (r"સબ[\s-]*રજિસ્ટ્રાર", ""), (r"માલિકી", ""),
        (r"\bRegistration Fee\b", "i"), (r"\bstamp duty\b", "i"),
    ]),
    ("affidavit", 4, [
        (r"\b(?:affidavit|deponent|verily|sworn)\b", "i"), (r"શપથ", ""), (r"જિહેર", ""), (r"દરખાસ્ત", ""),
        (r"\bI,?\s+\w+,?\s+(?:s\/o|d\/o|w\/o)\b", "i"), (r"\b(?:solemnly affirm|solemnly swear)\b", "i"),
    ]),
    ("bail_application", 5, [
        (r"\b(?:regular bail|anticipatory bail)\b", "i"), (r"\bSection (?:437A|438|437|439|440) (?:CrPC|BNSS)\b", "i"),
        (r"\b(?:prayer|bails?)\b.*\baccused\b", "i"), (r"જામીન", ""), (r"જામીનત જામીન", ""), (r"અગાઉ જામીન", ""),
        (r"\bthat the accused may be released on\b", "i"), (r"\b(?:parole|interim custody)\b", "i"),
    ]),
    ("writ_petition", 5, [
        (r"\bArticle (?:32|226|227)\b", "i"),
        (r"\b(?:writ petition|writ of (?:mandamus|habeas corpus|certiorari|prohibition|quo warranto))\b", "i"),
        (r"\b(?:Petitioner|Respondent) State(?: of)?\b", "i"), (r"\bdisposition of (?:the )?writ petition\b", "i"), (r"રીટ", ""),
        (r"રિટ", ""), (r"\blearned (?:Advocate|APP)\s+(?:for the )?Petitioner\s+prays\b", "i"),
    ]),
    ("legal_application", 1, [
        (r"અરજી", ""), (r"અરજીપત્ર", ""), (r"\b(?:prays|pray for) (?:that|it)\b", "i"),
        (r"\bIt is therefore respectfully prayed\b", "i"), (r"\bMost respectfully prayed\b", "i"),
        (r"\bapplication (?:under|dated)\b", "i"),
    ]),
    ("complaint", 1, [
        (r"\b(?:complaint|complainant) (?:under|u\/s)\b", "i"), (r"\b(?:S\.?O\.? No\.?)\s*\d+\/\d{4}", "i"),
        (r"\brepresented by\b.*\b(?:Advocate|Counsel)\b", "i"), (r"ફરિયાદ", ""),
        (r"\b(?:prays) that (?:the )?(?:complaint|application)", "i"),
    ]),
]

#: What a text must have one of, in lower case if the pattern is of any case, to match a pattern; without an entry, the pattern itself.
NEEDS = {
    r"\bSCC\s*OnLine": ["online"],
    r"\b(?:CRL\.?\s*A\.?|C\.?\s?R\.?|CRA)\s*\d+\/\d{4}": ["/"],
    r"\b(?:MANU|LD)\s*\d+": ["manu", "ld"],
    r"\bCORAM\b": ["coram"],
    r"\bJUDGMENT\b": ["judgment"],
    r"\b(?:HON'?ABLE|J)\s*:?\s*(?:JUSTICE|JUDGE)": ["stice", "dge"],
    r"\b(?:PLAINTIFF|APPELLANT)\s+VERSUS\b": ["plaintiff", "appellant"],
    r"\b(?:before|Judgment delivered by)\b": ["before", "judgment delivered by"],
    r"\b(?:Considering|It is ordered|Ordered that)\b": ["considering", "it is ordered", "ordered that"],
    r"\b(?:appeal|Revision) (?:is )?(?:allowed|dismissed|partly allowed)": ["allowed", "dismissed", "partly allowed"],
    r"\b(?:accused|Petitioner)\s+(?:is|was)\s+(?:acquitted|convicted|discharged)": ["acquitted", "convicted", "discharged"],
    r"\bC\.?O\.?\s*No\.?\s*\d+\/\d{4}": ["/"],
    r"\bOrder No\.?\s*\d+": ["order no"],
    r"\b(?:on|dated)\s+\d{1,2}\/\d{1,2}\/\d{4}": ["/"],
    r"\b(?:interim order|stay order|vacate order)\b": ["interim order", "stay order", "vacate order"],
    r"\bIt is ordered\b": ["it is ordered"],
    r"\b(?:learned|learnt) (?:Advocate|APP)\b": ["learn"],
    r"અરજી(?:નો)? નિરાખ": [" નિરાખ"],
    r"\bPetition(?:er)?\s+prays\b": ["petition"],
    r"\b(?:LEGAL|legal)\s+NOTICE\b": ["notice"],
    r"\bunder my instructions and on behalf of\b": ["under my instructions and on behalf of"],
    r"\bhereby (?:give|call|serve|put) you on notice\b": [" you on notice"],
    r"\byou are hereby (?:called|required|put) on notice\b": ["you are hereby "],
    r"\bwithin (\d+|seven|fifteen|thirty) days\b": ["within "],
    r"\b(?:take note|be informed) that\b": ["take note", "be informed"],
    r"\b(?:advocate|Advocate) (?:for|on behalf of) the (?:complainant|defendant|petitioner)\b": ["complainant", "defendant", "petitioner"],
    r"\bAll correspondence to be addressed to\b": ["all correspondence to be addressed to"],
    r"ફરિયાદ\s*(?:નોંધણી|નોંધણી\s*પત્ર|કોપી)?": ["ફરિયાદ"],
    r"\bFIR\s*(?:No\.?|Number|book|entry)?": ["fir"],
    r"\bFirst Information Report\b": ["first information report"],
    r"\b(?:Daily Diary|Station Diary|Diary No\.)\b": ["daily diary", "station diary", "diary no."],
    r"\bGD No\.|\bGeneral Diary\b": ["d no.", "eneral diary"],
    r"\b(?:s\/\d{4}|R\/No\.)\b": ["s/", "r/no."],
    r"\bPolice Station\b": ["Police Station"],
    r"\bStation House Officer\b": ["station house officer"],
    r"\bInformant\b": ["informant"],
    r"\b(?:Sections?)\s*\d+[A-Z]?\s*(?:IPC|BNS)\b": ["section"],
    r"\bSchedule of Offences\b": ["schedule of offences"],
    r"\b(?:charge[- ]?sheet|chargesheet)\b": ["charge"],
    r"\b(?:investigation report|final report|report under Section)\b": ["investigation report", "final report", "report under section"],
    r"\b(?:arrest(?:ing)? memo|arrest memo)\b": ["arrest"],
    r"\b(?:remand|remand memo)\b": ["remand"],
    r"\b(?:custody record|undertrial|convict|prisoner)\b": ["custody record", "undertrial", "convict", "prisoner"],
    r"\bFIR (?:copy|extract) (?:is )?(?:received|received at)\b": ["received"],
    r"\bSDO\b|\bI\.O\.P\.B\.?\b": ["SDO", "I.O.P.B"],
    r"\b(?:Government of (?:Gujarat|India))\b": ["government of "],
    r"\b(?:GR|G\.R\.) (?:No\.?)?\s*\d+\/\d{2,4}[-/]\s*\d+\b": ["/"],
    r"\b(?:Circular|Office Order|Government Order|Resolution)\b": ["circular", "office order", "government order", "resolution"],
    r"\b(?:Government Notification) No\.?\s*\d+": ["government notification no"],
    r"\b(?:Collector|District Collector|Secretary)\b": ["collector", "district collector", "secretary"],
    r"\b(?:Finance|Home|Revenue|Transport)\s+Department\b": ["department"],
    r"\b(?:hereby|is hereby)\s+(?:directed|instructed)\b": ["directed", "instructed"],
    r"\b(?:Settlement Deed|Reconciliation|MOU|Memorandum of Understanding)\b": ["settlement deed", "reconciliation", "mou", "memorandum of understanding"],
    r"\b(?:this deed|this agreement) is made\b": [" is made"],
    r"\b(?:Whereas|Whereas and Whereas)\b": ["whereas"],
    r"\bin consideration of\b": ["in consideration of"],
    r"\b(?:lessor|lessee|tenant)(?: shall)? (?:agrees|agrees to)\b": [" agrees"],
    r"\b1\. THIS DEED\b": ["1. this deed"],
    r"\b(?:first party|second party)\b": ["first party", "second party"],
    r"\b(?:purchase agreement|supply agreement|service agreement)\b": ["purchase agreement", "supply agreement", "service agreement"],
    r"\b(?:terms and conditions|force majeure|indemnity|warranty)\b": ["terms and conditions", "force majeure", "indemnity", "warranty"],
    r"\b(?:bill of supply|purchase order)\b": ["bill of supply", "purchase order"],
    r"\bperformance guarantee\b": ["performance guarantee"],
    r"\b(?:sale deed|conveyance deed|conveyance)\b": ["sale deed", "conveyance deed", "conveyance"],
    r"\b(?:7\/12|8-A|8A)\b": ["7/12", "8-A", "8A"],
    r"\b(?:Record of Rights|khata|khatauni|khunwari)\b": ["record of rights", "khata", "khatauni", "khunwari"],
    r"\b(?:mortgage deed|equitable mortgage|charge)\b": ["mortgage deed", "equitable mortgage", "charge"],
    r"\b(?:lease deed|licence|tenancy)\b": ["lease deed", "licence", "tenancy"],
    r"\b(?:survey number|block number|tp\s*\d+|survey\s*(?:no|number))\b": ["survey number", "block number", "tp", "survey"],
    r"\b(?:plot(?:s)?\s*(?:no|number)|shikren)\b": ["plot", "shikren"],
    r"\b(?:adhesion|adhésion) stamp\b": [" stamp"],
    r"પ્રકાર[:ઃ]?\s*વેચા": ["પ્રકાર"],
    r"સબ[\s-]*રજિસ્ટ્રાર": ["રજિસ્ટ્રાર"],
    r"\bRegistration Fee\b": ["registration fee"],
    r"\bstamp duty\b": ["stamp duty"],
    r"\b(?:affidavit|deponent|verily|sworn)\b": ["affidavit", "deponent", "verily", "sworn"],
    r"\bI,?\s+\w+,?\s+(?:s\/o|d\/o|w\/o)\b": ["s/o", "d/o", "w/o"],
    r"\b(?:solemnly affirm|solemnly swear)\b": ["solemnly "],
    r"\b(?:regular bail|anticipatory bail)\b": ["regular bail", "anticipatory bail"],
    r"\bSection (?:437A|438|437|439|440) (?:CrPC|BNSS)\b": ["section 4"],
    r"\b(?:prayer|bails?)\b.*\baccused\b": ["accused"],
    r"\bthat the accused may be released on\b": ["that the accused may be released on"],
    r"\b(?:parole|interim custody)\b": ["parole", "interim custody"],
    r"\bArticle (?:32|226|227)\b": ["article "],
    r"\b(?:writ petition|writ of (?:mandamus|habeas corpus|certiorari|prohibition|quo warranto))\b": ["petition", "mandamus", "habeas corpus", "certiorari", "prohibition", "quo warranto"],
    r"\b(?:Petitioner|Respondent) State(?: of)?\b": ["petitioner", "respondent"],
    r"\bdisposition of (?:the )?writ petition\b": ["disposition of "],
    r"\blearned (?:Advocate|APP)\s+(?:for the )?Petitioner\s+prays\b": ["petitioner"],
    r"\b(?:prays|pray for) (?:that|it)\b": ["pray"],
    r"\bIt is therefore respectfully prayed\b": ["it is therefore respectfully prayed"],
    r"\bMost respectfully prayed\b": ["most respectfully prayed"],
    r"\bapplication (?:under|dated)\b": ["application "],
    r"\b(?:complaint|complainant) (?:under|u\/s)\b": ["complain"],
    r"\b(?:S\.?O\.? No\.?)\s*\d+\/\d{4}": ["/"],
    r"\brepresented by\b.*\b(?:Advocate|Counsel)\b": ["represented by"],
    r"\b(?:prays) that (?:the )?(?:complaint|application)": ["prays that "],
}
