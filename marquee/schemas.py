"""Declared schemas as DDL text. Unknown input fields are dropped by the schema, not carried along."""

SESSION = "struct<date: date, time: string>"
SHOW = (
    "struct<time: string, endTime: string, location: string, locationName: string,"
    " price: string, Price: string, onSales: string>"
)
PROVIDER_ROW = (
    "UID string, version string, title string, category string, startDate string, endDate string,"
    " showUnit string, descriptionFilterHtml string, sourceWebPromote string,"
    " showInfo array<struct<time: string, endTime: string, location: string, locationName: string,"
    " price: string, onSales: string>>"
)
FEED = ("entry array<struct<url: string, title: string, summary: string, content: string>>")

EXHIBITION_COLUMNS = [
    "id", "title", "start", "end", "region", "venue", "address", "park", "price", "category", "summary",
    "url", "source", "sourceUid", "sourceVersion",
]
TICKET_COLUMNS = ["platform", "url", "checkedAt", "sessions", "price", "saleAt"]
LIVE_COLUMNS = [
    "id", "source", "sourceUid", "title", "performers", "region", "venue", "address", "sessions", "price",
    "saleAt", "saleNote", "ticketStatus", "ticketUrl", "ticketVerifiedAt", "tickets", "status", "statusNote",
    "summary", "verifiedAt", "revisions", "verificationMethod", "sessionFacts", "programKey",
]

ENVELOPE = (
    "sourceId string, kind string, reviewedAt string,"
    " traversal struct<scope: string, expectedPageIds: array<string>, complete: boolean>,"
    " pages array<struct<id: string, url: string, items: array<struct<sourceUid: string,"
    " officialFactsReviewed: boolean, evidence: map<string,string>>>>>"
)
LINK_CHECK = ("uid string, title string, url string, state string, checkedAt string")
RUN_STATUS = (
    "source_id string, kind string, checked_at string, state string, discovered bigint, included bigint,"
    " excluded bigint, pending bigint, failed bigint, reasons map<string,bigint>, last_success string,"
    " coverage_complete boolean, message string"
)
RACE_ROW = (
    "season string, raceName string, Circuit struct<circuitId: string>, date string, time string,"
    " FirstPractice struct<date: string, time: string>, SecondPractice struct<date: string, time: string>,"
    " ThirdPractice struct<date: string, time: string>, SprintQualifying struct<date: string, time: string>,"
    " Sprint struct<date: string, time: string>, Qualifying struct<date: string, time: string>"
)
