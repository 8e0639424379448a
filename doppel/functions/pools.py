"""Content pools that generated text is drawn from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Merchants, companies, products, descriptions, departments, titles, categories.
MERCHANTS = [
    "Amazon", "Walmart", "Target", "Costco", "Starbucks", "McDonald's", "Shell Gas Station", "Netflix", "Spotify",
    "Uber", "Lyft", "DoorDash", "Whole Foods", "Trader Joe's", "Home Depot", "Best Buy", "Apple Store",
    "CVS Pharmacy", "Walgreens", "Nike", "Adidas", "Zara", "H&M", "Pizza Hut", "Domino's", "Subway", "Chipotle",
    "Panera Bread", "7-Eleven", "Kroger", "Safeway", "Aldi", "Lidl", "IKEA", "Macy's", "Nordstrom", "T.J. Maxx",
    "Ross", "Dollar Tree", "Petco", "AutoZone", "Lowe's", "Office Depot", "GameStop", "Bath & Body Works", "Sephora",
    "Ulta Beauty", "Gap", "Old Navy", "Burlington", "TJ Maxx", "Five Below", "Dick's Sporting Goods",
]
COMPANIES = [
    "Acme Corp", "GlobalTech Solutions", "Pinnacle Industries", "Summit Enterprises", "Vertex Technologies",
    "Horizon Systems", "BlueSky Analytics", "Quantum Dynamics", "Atlas Manufacturing", "Meridian Group",
    "NovaStar Inc", "Catalyst Partners", "Apex Digital", "Silverline Corp", "TerraFirma Ltd", "Vanguard Services",
    "Nexus Innovations", "Prism Analytics", "Orion Labs", "ZenithWare", "Evergreen Solutions", "ClearPath Tech",
    "IronBridge Co", "Sapphire Systems", "RedOak Enterprises", "Falcon Industries", "Cobalt Engineering",
    "Jade Software", "Obsidian Corp", "Ember Technologies",
]
PRODUCTS = [
    "Widget Pro", "DataSync Module", "CloudLink Adapter", "SmartSensor X1", "PowerCell 5000", "UltraClean Filter",
    "RapidFlow Valve", "NanoCoat Shield", "FlexiMount Bracket", "TurboCharge Cable", "EcoBlend Cartridge",
    "PrecisionDrill Bit", "HyperCool Fan", "MegaGrip Tape", "OptiLens Camera", "QuickSeal Gasket", "IronClad Case",
    "AquaPure Pump", "SilentRun Motor", "BrightBeam LED", "CoreLock Bolt", "SwiftPrint Ink", "MaxVolt Battery",
    "ClearView Monitor", "ProFit Analyzer",
]
DESCRIPTIONS = [
    "Monthly subscription", "Online purchase", "In-store purchase", "Recurring payment", "Direct deposit",
    "Wire transfer", "ATM withdrawal", "POS transaction", "Mobile payment", "Refund", "Interest earned",
    "Service fee", "Insurance premium", "Utility bill", "Rent payment", "Grocery shopping", "Fuel purchase",
    "Restaurant dining", "Entertainment", "Healthcare payment",
]
DEPARTMENTS = [
    "Engineering", "Marketing", "Sales", "Human Resources", "Finance", "Operations", "Customer Support", "Legal",
    "Product", "Design", "Research & Development", "Quality Assurance", "IT", "Logistics", "Procurement",
]
TITLES = [
    "Software Engineer", "Data Analyst", "Product Manager", "UX Designer", "DevOps Engineer", "Marketing Specialist",
    "Sales Representative", "HR Coordinator", "Financial Analyst", "Project Manager", "QA Engineer",
    "Technical Writer", "System Administrator", "Business Analyst", "Compliance Officer",
]
CATEGORIES = [
    "Electronics", "Clothing", "Food & Beverage", "Home & Garden", "Health & Beauty", "Automotive",
    "Sports & Outdoors", "Books", "Toys & Games", "Office Supplies",
]
CREDIT_TEXTS = ["Transfer In", "Refund", "Interest", "Deposit", "Cashback"]
CREDIT_SOURCES = ["Bank Transfer", "PayPal", "Venmo", "Direct Deposit"]
BANKS = ["First National Bank", "City Bank", "Global Bank", "Pacific Bank", "Atlantic Bank"]
EMAIL_DOMAINS = ["gmail.com", "yahoo.com", "outlook.com", "company.com", "mail.com"]
CUSTOMER_DOMAINS = ["gmail.com", "yahoo.com", "outlook.com", "icloud.com"]

# The pools of the ur_PK locale.
PK_FIRST_NAMES = [
    "Muhammad", "Ahmed", "Ali", "Usman", "Bilal", "Hamza", "Umar", "Hassan", "Hussain", "Tariq", "Zain", "Shahbaz",
    "Kamran", "Imran", "Waqas", "Asif", "Babar", "Fakhar", "Shaheen", "Naseem", "Haris", "Shadab", "Rizwan",
    "Fatima", "Ayesha", "Zainab", "Maryam", "Sana", "Hira", "Sadia", "Noor", "Mahnoor", "Sidra", "Khadija", "Alizeh",
    "Anum", "Amna", "Iqra", "Rabia",
]
PK_LAST_NAMES = [
    "Khan", "Malik", "Chaudhry", "Butt", "Qureshi", "Siddiqui", "Sheikh", "Shah", "Ansari", "Abbasi", "Mughal",
    "Raja", "Bhatti", "Gill", "Akhtar", "Farooq", "Rehman", "Javed", "Mirza", "Baig", "Dar", "Wani", "Niazi",
]
PK_CITIES = [
    "Karachi", "Lahore", "Islamabad", "Rawalpindi", "Faisalabad", "Multan", "Peshawar", "Quetta", "Sialkot",
    "Gujranwala", "Hyderabad",
]
PK_AREAS = [
    "DHA Phase 5", "DHA Phase 6", "Gulberg III", "Model Town", "F-7/2", "F-8/3", "G-11/1", "Blue Area",
    "Clifton Block 2", "Bahria Town Phase 4", "Saddar", "Cantt", "Satellite Town", "Civil Lines", "Johar Town",
]
PK_BANKS = [
    "Habib Bank Limited (HBL)", "Meezan Bank", "United Bank Limited (UBL)", "MCB Bank", "Allied Bank Limited (ABL)",
    "Bank Alfalah", "Standard Chartered Bank Pakistan", "Faysal Bank", "Askari Bank",
]
PK_COMPANIES = [
    "Systems Limited", "Engro Corporation", "Lucky Cement", "Habib Metro", "Fatima Fertilizer", "Jazz (PMCL)",
    "Telenor Pakistan", "Zong CMPak", "Packages Limited", "Interloop Limited", "FrieslandCampina Engro",
]
PK_PHONE_PREFIXES = ["300", "301", "321", "333", "345", "312", "315"]
PK_DOMAINS = ["gmail.com", "yahoo.com", "outlook.com", "live.com"]

# Own pools for every other locale.
FIRST_NAMES = [
    "Alice", "Amir", "Anna", "Ben", "Carla", "Chen", "Clara", "Daniel", "Dora", "Elias", "Emma", "Felix", "Grace",
    "Hana", "Henry", "Ines", "Ivan", "Jack", "Julia", "Karim", "Laura", "Leo", "Lina", "Lucas", "Maria", "Mateo",
    "Maya", "Nora", "Oscar", "Paula", "Peter", "Rosa", "Samuel", "Sofia", "Thomas", "Vera", "Victor", "Yara", "Zoe",
]
LAST_NAMES = [
    "Adams", "Baker", "Brooks", "Carter", "Clark", "Cole", "Davies", "Diaz", "Evans", "Fischer", "Foster", "Garcia",
    "Gray", "Hughes", "Jansen", "Kim", "Klein", "Lopez", "Martin", "Meyer", "Moore", "Nguyen", "O'Brien", "Olsen",
    "Parker", "Patel", "Reed", "Rossi", "Santos", "Silva", "Smith", "Stone", "Torres", "Turner", "Weber", "Young",
]
STREETS = ["Oak", "Maple", "Cedar", "Park", "Lake", "Hill", "River", "Church", "Market", "Station", "Garden", "Mill"]
CITIES = ["Ashford", "Brookfield", "Clayton", "Dover", "Easton", "Fairview", "Greenville", "Hudson", "Kingston",
          "Lakewood", "Milford", "Newport", "Oakdale", "Riverside", "Salem", "Windsor"]
WORDS = ["amber", "basin", "cloud", "delta", "early", "field", "grain", "harbor", "island", "juniper", "kettle",
         "ladder", "meadow", "north", "orchard", "pebble", "quiet", "ripple", "silver", "timber", "under", "valley",
         "window", "yellow"]

POOLS = {
    "merchants": MERCHANTS, "companies": COMPANIES, "products": PRODUCTS, "descriptions": DESCRIPTIONS,
    "departments": DEPARTMENTS, "titles": TITLES, "categories": CATEGORIES,
}


def pool_rows() -> list[tuple[str, int, str]]:
    return [(name, i + 1, v) for name, values in POOLS.items() for i, v in enumerate(values)]


def content_pools(spark: SparkSession) -> DataFrame:
    """pool, position (from 1), value."""
    return spark.createDataFrame(pool_rows(), "pool string, position int, value string")
