"""The record types of the library."""

STORED_TEXT = "struct<path:string,mediaType:string,contentHash:string,textHash:string,byteLength:bigint>"
STORED_FILE = "struct<path:string,mediaType:string,contentHash:string,byteLength:bigint>"
CITATION = "struct<id:string,sourceId:string,locator:struct<url:string,heading:string,paragraph:int,fragment:string>,quote:string,note:string>"
GENERATED_BY = "struct<provider:string,model:string,thinkingLevel:string,sessionId:string,generatedAt:string>"
SOURCE = (
    "schemaVersion int, id string, kind string, title string, description string, authors array<string>, language string, publishedAt string, "
    f"capturedAt string, origin struct<locator:string,canonicalUrl:string>, content {STORED_TEXT}, rawCapture {STORED_FILE}, assets array<{STORED_FILE}>, "
    "capture struct<adapter:string,adapterVersion:string,extractor:string,extractorVersion:string>"
)
ARTICLE = (
    "schemaVersion int, id string, mode string, title string, slug string, description string, authors array<string>, language string, sourceIds array<string>, "
    f"body {STORED_TEXT}, citations array<{CITATION}>, createdAt string, supersedesArticleId string, "
    "archiveVerification struct<sourceId:string,sourceTextHash:string,verifiedAt:string>, "
    f"generatedBy {GENERATED_BY}, "
    "presentation struct<sourceFontStyle:string,bodyFontSizeAdjustment:int,imageScalePercent:int>"
)
EXPORT = (
    "schemaVersion int, id string, articleId string, format string, destination struct<type:string,vaultName:string,notePath:string,deviceLabel:string>, "
    f"status string, artifact {STORED_FILE}, assets array<{STORED_FILE}>, createdAt string, "
    "delivery struct<attemptedAt:string,confirmedAt:string,confirmationMethod:string,deliveredAt:string,failure:string>"
)
DRAFT = (
    "kind string, locator string, title string, author string, description string, publishedAt string, canonicalUrl string, content string, mediaType string, contentHash string, "
    "textHash string, rawContent string, rawMediaType string, adapter string, rejected string"
)
MODES = ("archive", "digest", "synthesis")
KINDS = ("url", "text", "markdown", "file")
FORMATS = ("markdown", "html", "pdf", "epub")
