"""What kinds of vertices and edges there are: their keys, properties and ends."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class VertexType:
    label: str
    key: str
    properties: frozenset[str]
    parents: tuple[str, ...] = ()


@dataclass(frozen=True)
class EdgeType:
    name: str
    source: tuple[str, ...]
    target: tuple[str, ...]
    properties: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Catalog:
    vertices: dict[str, VertexType] = field(default_factory=dict)
    edges: dict[str, EdgeType] = field(default_factory=dict)

    def family(self, label: str) -> set[str]:
        """A label, the labels that stand above it and those below."""
        below = {v.label for v in self.vertices.values() if label in v.parents}
        return {label, *self.vertices[label].parents, *below} if label in self.vertices else {label}

    def owners(self, name: str) -> set[str]:
        return {v.label for v in self.vertices.values() if name in v.properties} | {e.name for e in self.edges.values() if name in e.properties}

    def joins(self, edge: str, source: str | None, target: str | None) -> bool:
        e = self.edges[edge]
        fits = lambda label, ends: label is None or bool(self.family(label) & set(ends))
        return fits(source, e.source) and fits(target, e.target)


def vertex(label: str, key: str, properties: str, *parents: str) -> VertexType:
    return VertexType(label, key, frozenset(properties.split()) | {key}, parents)


def edge(name: str, source: str, target: str, properties: str = "") -> EdgeType:
    return EdgeType(name, tuple(source.split()), tuple(target.split()), frozenset(properties.split()))


# The labels, edge types and properties of the fund and company graph.
SECTIONS = ("Objective", "PerformanceCommentary", "Risk", "Strategy", "RiskFactor", "BusinessInformation", "LegalProceeding", "ManagementDiscussion", "Properties", "Financials")
VERTICES = [
    vertex("Provider", "name", "name"),
    vertex("Trust", "name", "name id"),
    vertex("Fund", "ticker", "ticker name cik securityExchange updatedAt"),
    vertex("ShareClass", "name", "name description"),
    vertex("Profile", "fundTicker", "summaryProspectus"),
    vertex("Section", "id", "id title text embedding sectionType secItem"),
    *(vertex(s, "id", "id title text embedding sectionType secItem" + " incomeStatement balanceSheet cashFlow fiscalYear" * (s == "Financials"), "Section") for s in SECTIONS),
    vertex("Chunk", "id", "id title text embedding chunkType subsection chunkIndex sectionName"),
    vertex("FinancialHighlight", "id", "turnover expenseRatio totalReturn netAssets netAssetsValueBeginning netAssetsValueEnd netIncomeRatio advisoryFees costsPer10k numberHoldings"),
    vertex("AverageReturns", "id", "return1y return5y return10y returnInception"),
    vertex("Portfolio", "seriesId", "seriesId date count"),
    vertex("Holding", "nodeId", "nodeId name ticker cusip isin lei country sector category categoryDesc categoryType issuerCategory issuerDesc"),
    vertex("AssetCategory", "code", "code name category subcategory"),
    vertex("Sector", "name", "name"),
    vertex("Region", "name", "name"),
    vertex("Company", "ticker", "ticker name cik"),
    vertex("Filing10K", "id", "id"),
    vertex("FinancialMetric", "id", "label value"),
    vertex("Segment", "id", "label value percentage"),
    vertex("Person", "name", "name"),
    vertex("CompensationPackage", "id", "totalCompensation shareholderReturn date fiscalYearEnd"),
    vertex("InsiderTransaction", "id", "id transactionDate transactionType position shares price value remainingShares"),
    vertex("Document", "accessionNumber", "accessionNumber url type filingDate reportingDate"),
    vertex("Image", "id", "id title category svg"),
    vertex("Table", "id", "title content"),
]
EDGES = [
    edge("MANAGES", "Provider", "Trust"),
    edge("ISSUES", "Trust", "Fund"),
    edge("HAS_SHARE_CLASS", "Fund", "ShareClass"),
    edge("DEFINED_BY", "Fund", "Profile", "year"),
    edge("HAS_FINANCIAL_HIGHLIGHT", "Fund", "FinancialHighlight", "year"),
    edge("HAS_AVERAGE_RETURNS", "Fund", "AverageReturns", "year"),
    edge("HAS_PORTFOLIO", "Fund", "Portfolio"),
    edge("HAS_HOLDING", "Portfolio", "Holding", "shares marketValue weight currency fairValueLevel isRestricted payoffProfile"),
    edge("HAS_SECTOR_ALLOCATION", "Fund", "Sector", "weight year"),
    edge("HAS_REGION_ALLOCATION", "Fund", "Region", "weight year"),
    edge("OF_CATEGORY", "Holding", "AssetCategory"),
    edge("REPRESENTS", "Holding", "Company"),
    edge("REPORTS_IN", "Company", "Filing10K", "year"),
    edge("HAS_METRIC", "Filing10K", "FinancialMetric"),
    edge("HAS_SEGMENT", "FinancialMetric", "Segment"),
    edge("HAS_SECTION", "Filing10K Profile", "Section"),
    edge("HAS_CHUNK", "Section", "Chunk"),
    edge("MANAGED_BY", "Fund", "Person", "year"),
    edge("HAS_CEO", "Company", "Person", "compensation"),
    edge("RECEIVED", "Person", "CompensationPackage"),
    edge("MADE_BY", "InsiderTransaction", "Person"),
    edge("HAS_INSIDER_TRANSACTION", "Company", "InsiderTransaction"),
    edge("EXTRACTED_FROM", "Fund Filing10K Portfolio Profile InsiderTransaction", "Document"),
    edge("HAS_CHART", "Fund", "Image", "year"),
    edge("HAS_TABLE", "Fund", "Table", "year"),
]
STANDARD = Catalog({v.label: v for v in VERTICES}, {e.name: e for e in EDGES})
