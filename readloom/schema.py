"""Row types of the tables that the operators pass on (DDL)."""

READS = "read_id BIGINT, name STRING, seq STRING, plus STRING, qual STRING"
UNIQUE = "uid BIGINT, seq STRING, len INT"
READ_MAP = "read_id BIGINT, uid BIGINT"
PLACEMENTS = "uid BIGINT, region STRING, start BIGINT, end BIGINT, strand STRING, n_mm INT"
DEVIATIONS = "uid BIGINT, off INT, ref STRING, obs STRING"
CONTIGS = "contig_id BIGINT, seq STRING"
SPANS = "contig_id BIGINT, start BIGINT, end BIGINT"
VCF = "chrom STRING, pos BIGINT, id STRING, ref STRING, alt STRING, qual STRING, filter STRING, info STRING"
SAM = "qname STRING, flag INT, rname STRING, pos BIGINT, mapq INT, cigar STRING, rnext STRING, pnext STRING, tlen STRING, seq STRING, qual STRING"
BED = "chrom STRING, start BIGINT, end BIGINT"
