"""Word lists, patterns and formats that results depend on."""

# Date layouts in trial order, as (guard, Spark pattern).
DATE_LAYOUTS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}(?:-\w{3}-|\s+\w{3}\s+)\d{4}$", "d MMM yyyy"),
    (r"^\d{1,2}(?:-\w{3}-|\s+\w{3}\s+)\d{2}$", "d MMM yy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"),
    (r"^\d{8}$", "ddMMyyyy"),
    (r"^\w{3}\s+\d{1,2},\s+\d{4}$", "MMM d, yyyy"),
    (r"^\w+\s+\d{1,2},\s+\d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{2}$", "d-M-yy"),
]
MONTH_FIRST = (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy")

# Layouts accepted for the date of an already parsed row.
PARSED_DATE_LAYOUTS = ["yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "yyyy/M/d", "M/d/yyyy"]

# Payment-rail references, then generic ones, first match wins.
REFERENCE_PATTERNS = [
    r"(?i)UPI[-/]?(\d+)[-/]?([A-Za-z0-9@._]+)",
    r"(?i)UPI\s*REF[:\s]*(\d+)",
    r"(?i)UPI[-/]([A-Za-z0-9]+)",
    r"(?i)IMPS[-/](\d+)",
    r"(?i)NEFT[-/]([A-Za-z0-9]+)",
    r"(?i)RTGS[-/]([A-Za-z0-9]+)",
    r"(?i)REF\s*(?:NO\.?|NUMBER)?[:\s]*([A-Za-z0-9]+)",
    r"(?i)TXN\s*(?:ID|NO)?[:\s]*([A-Za-z0-9]+)",
    r"(?i)TRANS(?:ACTION)?\s*(?:ID|NO)?[:\s]*([A-Za-z0-9]+)",
]

# Direction indicators and keywords.
CREDIT_INDICATORS = ["CR", "C", "CREDIT", "+"]
DEBIT_INDICATORS = ["DR", "D", "DEBIT", "-"]
DEBIT_KEYWORDS = [
    "DEBIT", "WITHDRAWAL", "PURCHASE", "PAYMENT", "PAID", "TRANSFER TO", "SENT TO",
    "EMI", "AUTOPAY", "BILL PAY", "ATM WDL", "POS", "ECOM",
]
CREDIT_KEYWORDS = [
    "CREDIT", "DEPOSIT", "REFUND", "CASHBACK", "REVERSAL", "TRANSFER FROM", "RECEIVED",
    "SALARY", "INTEREST", "DIVIDEND", "BY TRANSFER",
]

# Spellings of a bank, in order, and its standard name.
BANK_NAMES = [
    ("HDFC", ["HDFC BANK", "HDFCBANK", "HDFC"]),
    ("SBI", ["STATE BANK OF INDIA", "SBI", "SBIN"]),
    ("ICICI", ["ICICI BANK", "ICICIBANK", "ICICI"]),
    ("AXIS", ["AXIS BANK", "AXISBANK", "AXIS"]),
    ("KOTAK", ["KOTAK MAHINDRA", "KOTAK BANK", "KOTAK"]),
    ("IDFC FIRST", ["IDFC FIRST", "IDFC BANK", "IDFCFIRST", "IDFC"]),
    ("YES", ["YES BANK", "YESBANK", "YES"]),
    ("STANDARD CHARTERED", ["STANDARD CHARTERED", "SCB"]),
    ("CITIBANK", ["CITIBANK", "CITI BANK", "CITI"]),
    ("PNB", ["PUNJAB NATIONAL BANK", "PNB"]),
    ("BANK OF BARODA", ["BANK OF BARODA", "BOB"]),
    ("CANARA", ["CANARA BANK", "CANARA"]),
    ("UNION", ["UNION BANK", "UNION"]),
    ("INDIAN", ["INDIAN BANK", "INDIAN"]),
    ("INDUSIND", ["INDUSIND BANK", "INDUSIND"]),
    ("FEDERAL", ["FEDERAL BANK", "FEDERAL"]),
    ("RBL", ["RBL BANK", "RATNAKAR BANK", "RBL"]),
    ("BANDHAN", ["BANDHAN BANK", "BANDHAN"]),
]

# Account number patterns; the last one takes any long number.
ACCOUNT_PATTERNS = [
    r"(?i)A/C\s*(?:NO\.?)?\s*[:.]?\s*(\d{9,18})",
    r"(?i)ACCOUNT\s*(?:NO\.?|NUMBER)?\s*[:.]?\s*(\d{9,18})",
    r"(?i)ACCT\s*(?:NO\.?)?\s*[:.]?\s*(\d{9,18})",
    r"(\d{9,18})",
]

# Coarse category of a description, first class wins.
DESCRIPTION_CLASSES = [
    ("Food & Dining", "SWIGGY|ZOMATO|RESTAURANT|CAFE|FOOD|DOMINOS|PIZZA|BURGER|MCDONALDS|KFC|STARBUCKS|CHAAYOS|HOTEL"),
    ("Shopping", "AMAZON|FLIPKART|MYNTRA|AJIO|NYKAA|SHOPPING|MALL|STORE|RETAIL"),
    ("Transport", "UBER|OLA|RAPIDO|METRO|RAILWAY|IRCTC|PETROL|FUEL|PARKING|TOLL"),
    ("Groceries", "BIGBASKET|BLINKIT|GROFERS|ZEPTO|INSTAMART|DMART|GROCERY|SUPERMARKET"),
    ("Utilities", r"ELECTRICITY|WATER|GAS|INTERNET|BROADBAND|MOBILE|RECHARGE|BILL\s*PAY|AIRTEL|JIO|VI"),
    ("Entertainment", "NETFLIX|SPOTIFY|HOTSTAR|PRIME|YOUTUBE|MOVIE|PVR|INOX|CINEMA|GAMING"),
    ("Healthcare", "HOSPITAL|CLINIC|PHARMACY|MEDICAL|HEALTH|DOCTOR|APOLLO|MEDPLUS|NETMEDS"),
    ("Education", "SCHOOL|COLLEGE|UNIVERSITY|COURSE|UDEMY|COURSERA|EDUCATION|TUITION|BOOKS"),
    ("Investment", r"ZERODHA|GROWW|UPSTOX|MUTUAL\s*FUND|SIP|STOCKS|TRADING|INVESTMENT"),
    ("Insurance", "INSURANCE|LIC|POLICY|PREMIUM"),
    ("EMI", r"EMI|LOAN|BAJAJ\s*FIN|HDFC\s*LTD"),
    ("Transfer", "TRANSFER|NEFT|RTGS|IMPS|UPI"),
    ("Salary", "SALARY|PAYROLL|WAGES"),
    ("ATM", r"ATM|CASH\s*WITHDRAWAL|CASH\s*WDL"),
    ("Rent", "RENT|HOUSING|LEASE"),
]

# Merchant spellings and their canonical names.
CANONICAL_MERCHANTS = [
    (r"SWIGGY\s*\d*", "SWIGGY"),
    (r"ZOMATO\s*\d*", "ZOMATO"),
    (r"AMAZON\s*(PAY)?\s*\d*", "AMAZON"),
    (r"FLIPKART\s*\d*", "FLIPKART"),
    (r"UBER\s*(INDIA)?\s*\d*", "UBER"),
    (r"OLA\s*(CABS?)?\s*\d*", "OLA"),
    (r"BIGBASKET\s*\d*", "BIGBASKET"),
    (r"GROFERS\s*\d*", "BLINKIT"),
    (r"BLINKIT\s*\d*", "BLINKIT"),
    (r"ZERODHA\s*\d*", "ZERODHA"),
    (r"GROWW\s*\d*", "GROWW"),
    (r"PHONEPE\s*\d*", "PHONEPE"),
    (r"GPAY\s*\d*", "GOOGLE PAY"),
    (r"GOOGLE\s*PAY\s*\d*", "GOOGLE PAY"),
    (r"PAYTM\s*\d*", "PAYTM"),
    (r"NETFLIX\s*\d*", "NETFLIX"),
    (r"SPOTIFY\s*\d*", "SPOTIFY"),
    (r"YOUTUBE\s*\d*", "YOUTUBE"),
    (r"HOTSTAR\s*\d*", "HOTSTAR"),
    (r"PRIME\s*VIDEO\s*\d*", "AMAZON PRIME"),
]

# Parts removed from a description before matching, in order.
NORMALIZE_PATTERNS = [
    r"\d{4}[Xx*]{4,}\d{4}",
    r"\d{10,}",
    r"[A-Z]{2,3}\d{10,}",
    r"VPA:\s*\S+",
    r"REF\s*:\s*\S+",
    r"UPI/\d+/",
    r"IMPS/\d+/",
    r"NEFT/\d+/",
    r"\d{2}/\d{2}/\d{2,4}",
    r"\d{2}:\d{2}(:\d{2})?",
    r"INR\s*[\d,\.]+",
    r"RS\.?\s*[\d,\.]+",
    r"@[a-z0-9]+",
]

# Words that say nothing about the merchant.
NOISE_WORDS = [
    "pvt", "ltd", "private", "limited", "india", "inr", "debit", "credit", "card", "payment",
    "transaction", "ref", "no", "number", "acc", "account", "bank", "international", "domestic",
    "online", "pos", "ecom", "request", "successful", "completed", "approved",
]

# Places of a UPI id and of a merchant name in a description.
UPI_ID_PATTERNS = [
    r"([a-z0-9._-]+@[a-z]+)",
    r"VPA[:\s]+([a-z0-9._-]+@[a-z]+)",
    r"to\s+([a-z0-9._-]+@[a-z]+)",
]
MERCHANT_NAME_PATTERNS = [
    r"(?:to|at|from)\s+([a-z][a-z\s]{2,30}?)(?:\s+(?:ref|upi|imps|neft|via|for)|$)",
    r"pos\s+(?:\d+\s+)?([a-z][a-z\s]{2,30})",
    r"(?:upi|imps|neft)[/-]?[a-z]*[/-]([a-z][a-z\s]{2,25})",
    r"^([a-z][a-z\s]{2,25})(?:\s+(?:payment|purchase|bill|recharge))",
]

# Transaction classes of bank narrations, first class wins.
BANK_NARRATIONS = [
    (r"salary|sal\s*cr|payroll|stipend|wages|emoluments", "Income", "Salary"),
    (r"atm\s*(wd|wdl|withdrawal|cash)|cash\s*wd|nfs.*wd|atm.*withdrawal", "Transfer", "Self Transfer"),
    (r"neft|rtgs|imps|ft\s*cr|ft\s*dr|fund\s*transfer", "Transfer", "NEFT/RTGS/IMPS"),
    (r"upi[/-]|upi\s*cr|upi\s*dr|@\w+", "Transfer", "UPI Transfer"),
    (r"emi|loan\s*emi|auto\s*debit.*emi|si.*emi", "Financial", "EMI Payment"),
    (r"int\s*(cr|paid)|interest\s*(credit|earned)|savings\s*interest", "Income", "Interest Income"),
    (r"dividend|div\s*cr", "Income", "Dividend"),
    (r"cashback|cash\s*back|cb\s*cr|reward", "Income", "Cashback"),
    (r"refund|reversal|cancelled.*transaction", "Income", "Refund"),
    (r"cc\s*payment|credit\s*card\s*payment|card\s*bill", "Financial", "Credit Card Bill"),
    (r"sip|systematic\s*investment|mutual\s*fund|mf\s*purchase", "Financial", "SIP"),
    (r"insurance|premium|prem\s*payment", "Financial", "Insurance Premium"),
]

# Debit amount ranges (both ends inclusive), in order.
AMOUNT_RANGES = [
    (10, 100, "Food & Dining", "Street Food", 0.4),
    (10, 100, "Food & Dining", "Coffee/Tea", 0.4),
    (100, 500, "Utilities", "Mobile Recharge", 0.35),
    (30, 200, "Transport", "Metro", 0.35),
    (50, 500, "Transport", "Cab/Auto", 0.35),
    (200, 1500, "Food & Dining", "Food Delivery", 0.30),
    (500, 5000, "Food & Dining", "Groceries", 0.30),
    (500, 5000, "Transport", "Petrol", 0.35),
    (500, 10000, "Utilities", "Electricity", 0.30),
    (149, 700, "Entertainment", "OTT Subscriptions", 0.40),
    (10000, 100000, "Housing", "Rent", 0.30),
    (5000, 100000, "Financial", "EMI Payment", 0.25),
    (1000, 500000, "Financial", "Investment", 0.25),
]

# Subscription words and typical subscription prices.
SUBSCRIPTION_WORDS = [
    "netflix", "spotify", "prime", "hotstar", "disney", "zee5", "youtube", "apple music",
    "gaana", "gym", "membership", "subscription", "monthly", "premium",
]
SUBSCRIPTION_PRICES = [99, 149, 199, 299, 399, 499, 649, 699, 999, 1499]

# Suspicious text, as regular expressions.
SQL_INJECTION_PATTERNS = [
    r"(\b(SELECT|INSERT|UPDATE|DELETE|DROP|UNION|ALTER|CREATE|TRUNCATE|EXEC|EXECUTE)\b)",
    r"(--|;|/\*|\*/|@@|@)",
    r"(\bOR\b\s+\d+\s*=\s*\d+)",
    r"(\bAND\b\s+\d+\s*=\s*\d+)",
    r"(\bOR\b\s*['\"].*['\"])",
    r"(\bUNION\b\s+\bSELECT\b)",
    r"(\bINTO\s+OUTFILE\b)",
    r"(\bLOAD_FILE\b)",
    r"(BENCHMARK\s*\()",
    r"(SLEEP\s*\()",
    r"(WAITFOR\s+DELAY)",
    r"(;.*--)",
    r"('\s*OR\s*')",
    r"(1\s*=\s*1)",
    r"(1\s*'\s*=\s*'\s*1)",
]
MARKUP_PATTERNS = [
    r"<script[^>]*>.*?</script>",
    r"javascript:",
    r"vbscript:",
    r"on\w+\s*=",
    r"<iframe[^>]*>",
    r"<object[^>]*>",
    r"<embed[^>]*>",
    r"<form[^>]*>",
    r"<input[^>]*>",
    r"<img[^>]*onerror",
    r"<svg[^>]*onload",
    r"expression\s*\(",
    r"url\s*\(",
    r"<!--.*-->",
    r"&\{",
    r"<\s*meta",
    r"<\s*link",
    r"<\s*style",
    r"data:",
]

# Decimals and largest amount per currency.
CURRENCY_LIMITS = {
    "USD": (2, "999999999.99"),
    "EUR": (2, "999999999.99"),
    "GBP": (2, "999999999.99"),
    "INR": (2, "9999999999.99"),
    "JPY": (0, "99999999999"),
}
CURRENCY_SYMBOLS = {"USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "INR": "₹"}
AMOUNT_OVERFLOW = "9999999999999.99"
