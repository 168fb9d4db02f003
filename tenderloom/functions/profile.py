"""The scoring profile: what to look for in an opportunity, and what each find is worth.

A profile is plain data.  ``DEFAULT`` is a general information-technology
services profile; every operator takes a profile as a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Capability:
    key: str
    label: str
    points: int
    phrases: tuple[str, ...]


@dataclass(frozen=True)
class Agency:
    name: str
    aliases: tuple[str, ...] = ()
    it_only: bool = False


@dataclass(frozen=True)
class Profile:
    version: int = 1
    capabilities: tuple[Capability, ...] = ()
    labor: tuple[tuple[str, str], ...] = ()
    technologies: tuple[tuple[str, str], ...] = ()
    functional_points: int = 4
    functional: tuple[str, ...] = ()
    schedule_points: int = 6
    schedule_terms: tuple[str, ...] = ()
    vehicle_points: int = 4
    vehicle_terms: tuple[str, ...] = ()
    solicitations: tuple[tuple[str, int], ...] = ()
    set_asides: tuple[tuple[str, int, tuple[str, ...]], ...] = ()
    federal_points: int = 6
    federal: tuple[Agency, ...] = ()
    state_points: int = 5
    states: tuple[tuple[str, str], ...] = ()
    exclusions: tuple[tuple[str, tuple[str, ...]], ...] = ()
    naics_points: int = 6
    naics: tuple[str, ...] = ()
    value_bands: tuple[tuple[float | None, int, str], ...] = ()
    pursue: int = 80
    capture_review: int = 60
    manual_review: int = 40
    min_days: int = 10
    urgent_max: int = 20
    standard_max: int = 45
    override_points: int = 7
    general_label: str = field(default="Small Business (general)")


# Phrases, points and bands of the default profile.
DEFAULT = Profile(
    capabilities=(
        Capability("program_management", "Program Management", 9, ("Program Management", "Project Management", "PMO Support", "Program Office Support", "Project Management Office", "Technical Program Management", "IT Program Management", "Program Support Services", "Management Support Services", "Enterprise Program Management")),
        Capability("acquisition_support", "Acquisition Support", 7, ("Acquisition Support", "Contract Support", "Procurement Support", "Contract Administration", "Acquisition Management", "Federal Acquisition Support", "Procurement Operations", "Source Selection Support", "Contract Closeout", "Acquisition Lifecycle")),
        Capability("it_modernization", "IT Modernization", 10, ("Digital Transformation", "Business Process Modernization", "IT Modernization", "Legacy System Modernization", "Modernization Services", "Enterprise Modernization")),
        Capability("application_development", "Application Development", 10, ("Application Development", "Software Development", "Agile Development", "Full Stack Development", "DevSecOps", "Systems Integration", "API Integration", "Custom Software Development", "Enterprise Application Support", "Low Code", "Microsoft Power Platform", "PowerApps", "Power Automate")),
        Capability("data_analytics", "Data Analytics", 9, ("Data Analytics", "Data Management", "Business Intelligence", "Dashboard Development", "Data Warehouse", "Data Governance", "Data Integration", "ETL", "SQL", "Reporting Services", "Power BI", "Tableau")),
        Capability("ai", "AI", 9, ("Artificial Intelligence", "AI", "Machine Learning", "Generative AI", "Intelligent Automation", "Robotic Process Automation", "RPA", "AI Enablement", "AI Integration", "AI Services")),
        Capability("cloud", "Cloud", 8, ("Cloud Migration", "Cloud Engineering", "Azure", "AWS", "Cloud Modernization", "Cloud Operations", "Cloud Support", "Hybrid Cloud")),
        Capability("cybersecurity", "Cybersecurity", 8, ("Cybersecurity", "Information Security", "Security Operations", "SOC", "Vulnerability Management", "Zero Trust", "Risk Management Framework", "Continuous Monitoring", "Security Assessment")),
        Capability("infrastructure", "Infrastructure", 6, ("Infrastructure Support", "Enterprise IT", "Systems Administration", "Network Support", "IT Operations", "Enterprise Operations")),
        Capability("service_desk", "Service Desk", 7, ("Service Desk", "Help Desk", "IT Support", "End User Support", "Customer Support", "Tier 1", "Tier 2", "Tier 3")),
        Capability("business_analysis", "Business Analysis", 7, ("Business Analysis",)),
    ),
    labor=(("Program Manager", "program_management"), ("Project Manager", "program_management"), ("Business Analyst", "business_analysis"), ("Functional Analyst", "business_analysis"), ("Technical Writer", "program_management"), ("Solutions Architect", "application_development"), ("Enterprise Architect", "application_development"), ("Database Administrator", "data_analytics"), ("Data Analyst", "data_analytics"), ("Data Engineer", "data_analytics"), ("Software Engineer", "application_development"), ("Software Developer", "application_development"), ("Full Stack Developer", "application_development"), ("Cloud Engineer", "cloud"), ("DevSecOps Engineer", "application_development"), ("Cybersecurity Analyst", "cybersecurity"), ("Help Desk Specialist", "service_desk"), ("Systems Administrator", "infrastructure"), ("Network Engineer", "infrastructure"), ("QA Analyst", "application_development"), ("Test Engineer", "application_development")),
    technologies=((".NET", "application_development"), ("C#", "application_development"), ("SQL Server", "data_analytics"), ("SharePoint", "application_development"), ("Microsoft Azure", "cloud"), ("Power BI", "data_analytics"), ("Power Platform", "application_development"), ("Dynamics 365", "application_development"), ("AWS", "cloud"), ("Azure", "cloud"), ("Kubernetes", "cloud"), ("Docker", "cloud"), ("Terraform", "cloud"), ("Java", "application_development"), ("Python", "application_development"), ("JavaScript", "application_development"), ("React", "application_development"), ("Angular", "application_development"), ("Node.js", "application_development"), ("REST API", "application_development"), ("Oracle", "data_analytics"), ("PostgreSQL", "data_analytics"), ("MySQL", "data_analytics")),
    functional=("Administrative Support", "Program Support", "Business Operations", "Technical Assistance", "Technical Support", "Operational Support", "Enterprise Support", "Mission Support", "Management Consulting", "Organizational Change Management"),
    schedule_terms=("GSA MAS", "Multiple Award Schedule"),
    vehicle_terms=("BPA", "Blanket Purchase Agreement", "Task Order"),
    solicitations=(("RFP", 2), ("RFQ", 2), ("RFI", 1), ("Sources Sought", 1), ("ITB", 2), ("IFB", 2)),
    set_asides=(
        ("8(a) Set-Aside", 10, ("8(a)", "8a set aside", "8(a) set-aside", "8(a) sole source")),
        ("Sole Source / Direct Award", 10, ("Sole Source", "Direct Award")),
        ("WOSB Set-Aside", 10, ("Woman-Owned Small Business", "Women-Owned Small Business", "WOSB", "EDWOSB")),
        ("Small Business Set-Aside", 8, ("Small Business Set Aside", "Small Business Set-Aside", "Total Small Business")),
        ("HUBZone", 6, ("HUBZone",)),
        ("SDVOSB", 6, ("SDVOSB", "Service-Disabled Veteran-Owned")),
        ("MBE", 6, ("MBE", "Minority Business Enterprise")),
        ("Small Business (general)", 2, ("Small Business", "Socioeconomic Set Aside", "Socioeconomic Set-Aside")),
    ),
    federal=(
        Agency("GSA", ("General Services Administration",)),
        Agency("Department of Transportation", ("DOT",)),
        Agency("FAA", ("Federal Aviation Administration",)),
        Agency("FMCSA", ("Federal Motor Carrier Safety Administration",)),
        Agency("HUD", ("Housing and Urban Development",)),
        Agency("HHS", ("Health and Human Services",)),
        Agency("CMS", ("Centers for Medicare & Medicaid Services", "Centers for Medicare and Medicaid Services")),
        Agency("NIH", ("National Institutes of Health",)),
        Agency("CDC", ("Centers for Disease Control",)),
        Agency("DHS", ("Department of Homeland Security", "Homeland Security")),
        Agency("CBP", ("Customs and Border Protection",)),
        Agency("USCIS", ("Citizenship and Immigration Services",)),
        Agency("DOJ", ("Department of Justice",)),
        Agency("Treasury", ("Department of the Treasury",)),
        Agency("IRS", ("Internal Revenue Service",)),
        Agency("USDA", ("Department of Agriculture",)),
        Agency("VA", ("Veterans Affairs", "Department of Veterans Affairs")),
        Agency("DoD", ("Department of Defense", "Defense Department"), it_only=True),
        Agency("DOE", ("Department of Energy",)),
        Agency("NHTSA", ("National Highway Traffic Safety Administration",)),
        Agency("FDIC", ("Federal Deposit Insurance Corporation",)),
    ),
    states=(("Virginia", "VA"), ("Maryland", "MD"), ("Pennsylvania", "PA"), ("New York", "NY"), ("New Jersey", "NJ"), ("North Carolina", "NC"), ("South Carolina", "SC"), ("Georgia", "GA"), ("Florida", "FL"), ("Texas", "TX"), ("Ohio", "OH"), ("Minnesota", "MN"), ("Mississippi", "MS")),
    exclusions=(
        ("Construction", ("Construction", "Roofing", "HVAC", "Plumbing", "Electrical", "Janitorial", "Landscaping", "Snow Removal", "Concrete", "Paving")),
        ("Medical", ("Pharmaceuticals", "Medical Equipment", "Nursing", "Physician", "Hospital Equipment")),
        ("Vehicles", ("Vehicle Purchase", "Fleet Vehicles", "Buses", "Heavy Equipment")),
        ("Supplies", ("Office Supplies", "Furniture", "Uniforms", "Food Service", "Fuel")),
        ("Architecture", ("Architectural Design", "Civil Engineering", "Surveying")),
    ),
    naics=("541511", "541512", "541513", "541519", "518210"),
    value_bands=((25_000, -2, "< $25k"), (100_000, 0, "$25k–$100k"), (1_000_000, 2, "$100k–$1M"), (10_000_000, 3, "$1M–$10M"), (None, 1, "> $10M")),
)


def problems(profile: Profile) -> list[str]:
    """What keeps a profile from being saved."""
    found = [] if isinstance(profile.capabilities, tuple) else ["capabilities must be a list"]
    numbers = {"pursue": profile.pursue, "capture_review": profile.capture_review, "manual_review": profile.manual_review, "min_days": profile.min_days}
    return found + [f"{k} must be a number" for k, v in numbers.items() if not isinstance(v, int | float) or isinstance(v, bool)]


def next_version(profile: Profile, current: int) -> Profile:
    if found := problems(profile):
        raise ValueError("; ".join(found))
    return replace(profile, version=current + 1)


def parse_pairs(text: str) -> tuple[tuple[str, str], ...]:
    """Lines ``Term -> group``; lines of another form are dropped."""
    parts = [[x.strip() for x in line.split("->")] for line in text.splitlines()]
    return tuple((p[0], p[1]) for p in parts if len(p) == 2 and all(p))


def parse_points(text: str) -> tuple[tuple[str, int], ...]:
    """Lines ``Term: points``; lines without a whole number after the last colon are dropped."""
    out = []
    for line in text.splitlines():
        term, _, points = line.rpartition(":")
        if term.strip() and points.strip().lstrip("-").isdigit():
            out.append((term.strip(), int(points)))
    return tuple(out)


def parse_agencies(text: str) -> tuple[Agency, ...]:
    """Lines ``Name | alias; alias | IT-ONLY``; the last two parts may be missing, empty lines are dropped."""
    out = []
    for line in text.splitlines():
        name, *rest = [x.strip() for x in line.split("|")]
        if name:
            aliases = tuple(a.strip() for a in rest[0].split(";") if a.strip()) if rest else ()
            out.append(Agency(name, aliases, len(rest) > 1 and rest[1].upper() == "IT-ONLY"))
    return tuple(out)
