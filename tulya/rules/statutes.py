"""Statutes and what replaced them, and law-report abbreviations."""

#: Token, old act, new token, new act, note.
STATUTES = [
    ("IPC", "Indian Penal Code, 1860", "BNS", "Bharatiya Nyaya Sanhita, 2023",
     "In force from 1 July 2024. Section numbering is not 1:1; only the corresponding section may be cited."),
    ("CrPC", "Code of Criminal Procedure, 1973", "BNSS", "Bharatiya Nagarik Suraksha Sanhita, 2023", "In force from 1 July 2024."),
    ("IEA", "Indian Evidence Act, 1872", "BSA", "Bharatiya Sakshya Adhiniyam, 2023", "In force from 1 July 2024."),
    ("CPC", "Code of Civil Procedure, 1908", "CPC", "Code of Civil Procedure, 1908 (unchanged)", "No replacement enacted."),
    ("NI Act", "Negotiable Instruments Act, 1881", "NI Act", "Negotiable Instruments Act, 1881 (amended by BNS)",
     "Partially amended by the BNS Act."),
    ("SARFAESI", "Securitisation and Reconstruction of Financial Assets and Enforcement of Security Interest Act, 2002",
     "SARFAESI", "Same", None),
    ("PMLA", "Prevention of Money Laundering Act, 2002", "PMLA", "Same", None),
    ("POCSO", "Protection of Children from Sexual Offences Act, 2012", "POCSO", "Same", None),
    ("NDPS", "Narcotic Drugs and Psychotropic Substances Act, 1985", "NDPS", "Same", None),
]

COURT_ABBREVIATIONS = {
    "SCC": "Supreme Court Cases",
    "SCR": "Supreme Court Reports",
    "AIR": "All India Reporter",
    "SCC OnLine": "Supreme Court Cases Online",
    "SCC OnLine Bom": "Supreme Court Cases Online (Bombay)",
    "SCC OnLine Del": "Supreme Court Cases Online (Delhi)",
    "SCC OnLine Guj": "Supreme Court Cases Online (Gujarat)",
    "1 SCC": "Supreme Court Cases, Volume 1",
    "3 SCC": "Supreme Court Cases, Volume 3",
    "4 SCC": "Supreme Court Cases, Volume 4",
    "AIJ": "All India Journal",
    "Guj LH": "Gujarat Law Herald",
    "GLR": "Gujarat Law Reports",
    "SCR (Supp)": "Supreme Court Reports (Supplement)",
    "MANU": "MANU (Legal database citation)",
}

#: Document type, label, short label, what it is, register.
DOC_TYPES = [
    ("court_judgment", "Court Judgment", "Judgment", "A reasoned judicial decision with findings of fact and law.", "judgment"),
    ("court_order", "Court Order", "Order", "A disposal order, interim order or procedural order of a court.", "order"),
    ("legal_notice", "Legal Notice", "Notice", "Pre-litigation notice or legal demand from an advocate or party.", "correspondence"),
    ("fir_document", "FIR / Police Document", "FIR", "First Information Report, its registration extract or related police record.", "statutory"),
    ("police_report", "Police Report", "Police", "Investigation report, charge sheet, custody record or police report.", "statutory"),
    ("government_order", "Government Order", "Govt. Order", "Notification, GR, circular or administrative order of a government body.", "order"),
    ("agreement", "Agreement", "Agreement", "Settlement deed, MOU, lease or other consensual arrangement.", "instrument"),
    ("contract", "Contract", "Contract", "Contract, purchase agreement or commercial instrument.", "instrument"),
    ("property_document", "Property Document", "Property", "Sale deed, mortgage deed, partition deed, land record extract or title document.", "instrument"),
    ("legal_application", "Legal Application", "Application", "Application, petition or affidavit filed in a proceeding.", "application"),
    ("affidavit", "Affidavit", "Affidavit", "Sworn statement of a party or witness.", "application"),
    ("complaint", "Complaint", "Complaint", "Plaint, written complaint or grievance representation.", "application"),
    ("bail_application", "Bail Application", "Bail", "Anticipatory or regular bail application with supporting grounds.", "application"),
    ("writ_petition", "Writ Petition", "Writ", "Writ petition under Article 226 or 227 of the Constitution.", "application"),
    ("other_legal", "Other Legal Document", "Other", "Legal document that did not match a more specific type.", "instrument"),
]
#: The register of a type that isn't listed; its label is itself.
REGISTER = "instrument"
