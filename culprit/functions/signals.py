"""Named signals of the differential: keyword lists, unions, a negation and change signals."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Signal:
    kind: str  # log | union | absent | delta
    description: str
    values: list[str]


# --- fixed values: named signals; patterns are tried in order ---------------------------------------
SIGNALS = {
    "cache.restore.detected": Signal("log", "a cache restore or cache hit step was detected", [
        "cache hit", "restored cache", "restore cache", "cache restored", "using cache", "actions/cache", "cache key",
    ]),
    "cache.restore.absent": Signal("absent", "no cache restore step was detected", ["cache.restore.detected"]),
    "dependency.cache.corrupt": Signal("log", "cache integrity or archive corruption was reported", [
        "cache is corrupted", "corrupt cache", "invalid cache", "cache hit but install failed", "checksum mismatch",
        "hash mismatch", "unexpected end of archive", "corrupted tar archive", "bad gzip",
    ]),
    "dependency.resolution.conflict": Signal("log", "resolver conflict wording points to incompatible dependency requirements", [
        "conflicting requirements", "dependency conflict", "version conflict", "incompatible versions",
        "requires a different version", "error: there is a conflict", "failed to resolve dependencies",
        "dependency resolution failed",
    ]),
    "dependency.lockfile.sync_error": Signal("union", "a lockfile or generated dependency metadata drift signal was present", [
        "dependency.npm.lockfile.sync_error", "dependency.pnpm.lockfile.sync_error", "dependency.yarn.lockfile.sync_error",
        "dependency.poetry.lockfile.stale", "dependency.go.sum.missing",
    ]),
    "dependency.npm.lockfile.sync_error": Signal("log", "npm reported package.json and package-lock.json drift", [
        "npm ci can only install packages when your package.json and package-lock.json",
        "package.json and package-lock.json are in sync", "missing package-lock.json",
        "npm err! cipm can only install packages", "package-lock.json does not exist",
        "run `npm install` to generate a lockfile",
    ]),
    "dependency.pnpm.lockfile.sync_error": Signal("log", "pnpm reported a frozen lockfile mismatch", [
        "err_pnpm_outdated_lockfile", "err_pnpm_frozen_lockfile", "err_pnpm_lockfile_version",
        "cannot install with `frozen-lockfile`", "pnpm-lock.yaml is not up to date", "lockfile is not up to date with",
        "run `pnpm install` to update the lockfile", "pnpm install --frozen-lockfile",
    ]),
    "dependency.yarn.lockfile.sync_error": Signal("log", "Yarn reported an out-of-date immutable or frozen lockfile", [
        "your lockfile needs to be updated", "frozen-lockfile", "yarn.lock: no such file or directory",
        "error your lockfile needs to be updated", "yarn install --frozen-lockfile", "yn0028", "--immutable",
        "the lockfile would have been modified by this install",
    ]),
    "dependency.poetry.lockfile.stale": Signal("log", "Poetry reported that pyproject.toml and poetry.lock drifted apart", [
        "poetry.lock is not consistent with pyproject.toml", "run `poetry lock [--no-update]` to fix it.",
        "installing dependencies from lock file", "version solving failed",
    ]),
    "dependency.go.sum.missing": Signal("log", "Go reported missing or stale module checksum metadata", [
        "missing go.sum entry for module providing package", "go.sum file is not up to date", "verifying module",
        "no required module provides",
    ]),
    "dependency.hash.mismatch": Signal("log", "a package integrity hash mismatch was reported", [
        "these packages do not match the hashes from the requirements file", "expected sha256", "hash mismatch (got:",
        "does not match expected hash", "record mismatch", "hash of the downloaded file",
        "there are no versions that match the hash",
    ]),
    "dependency.package.not_found": Signal("log", "the package manager could not find the requested package or version", [
        "error: could not find a version that satisfies", "error: no matching distribution found",
        "could not find package", "package not found", "e: unable to locate package",
    ]),
    "dependency.pip.install.failed": Signal("log", "pip-specific install or wheel-building signals were present", [
        "pip install", "pip._internal", "resolutionimpossible", "could not build wheels for",
        "error: command 'gcc' failed", "error: pip's dependency resolver", "requirements were not successfully fulfilled",
        "preparing metadata (setup.py) did not run successfully", "could not fetch url", "connection error",
        "error: failed building wheel",
    ]),
    "dependency.lockfile.changed": Signal("delta", "dependency-related files changed in the delta", ["delta.dependency.changed"]),
    "dependency.scope.changed": Signal("delta", "the failure scope changed in the delta", ["delta.scope.changed"]),
    "runtime.node.version.mismatch": Signal("log", "Node.js engine or version requirements were violated", [
        "the engine \"node\" is incompatible with this module", "required engine node", "requires node version",
        "engine: unsatisfied", "unsupported engine", "error node@", "warning: you are using node.js",
        "this version of node is not supported", "expected node version", "engines: {\"node\":",
    ]),
    "runtime.language.version.mismatch": Signal("log", "Python, Ruby, or Go runtime requirements were violated", [
        "python version", "requires python", "requires ruby version", "go version", "unsupported python", "ruby version",
        "go.mod requires go",
    ]),
    "runtime.version.mismatch": Signal("union", "a runtime version mismatch signal was present", [
        "runtime.node.version.mismatch", "runtime.language.version.mismatch",
    ]),
    "test.retry.detected": Signal("log", "the failure looked intermittent or retried", [
        "failed on attempt", "intermittent failure", "test is flaky", "flaky test", "retry attempt",
        "test passed on retry", "sporadically fails",
    ]),
    "test.timeout.detected": Signal("log", "the test runner reported a timeout or hang", [
        "test timed out", "exceeded timeout", "timeout - async callback was not invoked within", "test timeout of",
        "jest timeout", "go test -timeout", "test exceeded", "async test timed out", "waiting for assertion",
    ]),
    "test.parallel.resource_conflict": Signal("log", "parallel test execution collided on a shared resource", [
        "resource is busy", "test is not parallelizable", "race detected", "too many connections", "database locked",
    ]),
    "test.fixture.missing": Signal("log", "the failing test could not load required fixture or seed data", [
        "fixture not found", "missing fixture", "fixture file missing", "filenotfounderror", "could not find test data",
        "test helper", "before(:each) failed", "beforeall", "setup failed", "testdata",
    ]),
    "test.database.duplicate_state": Signal("log", "duplicate rows or unexpected existing data point to database state pollution", [
        "already exists", "duplicate key value", "uniqueconstraintviolation", "integrityerror", "duplicate entry",
        "expected count to be", "pg::uniqueviolation", "sqlstate 23505", "violates unique constraint",
    ]),
    "test.order.dependency": Signal("log", "the failure referenced leaked state or prior-test ordering", [
        "depends on previous test", "test order", "test assumes", "leaked state", "global state", "left over from previous",
    ]),
    "test.failure.introduced": Signal("delta", "the delta introduced a newly failing test", ["delta.test.failure.introduced"]),
    "error.new": Signal("delta", "the delta added a new error signature", ["delta.error.new"]),
}
DEFAULT_WEIGHTS = {"support": 0.40, "contradict": -0.35, "discriminator": 0.25}
WORDING = {
    "log.contains": 'log contains "{}"',
    "log.absent": 'log does not contain "{}"',
    "delta.signal": 'delta signal "{}" is present',
    "delta.absent": 'delta signal "{}" is absent',
    "context.stage": 'analysis stage is "{}"',
    "context.stage.absent": 'analysis stage is not "{}"',
}
# --- end of fixed values -------------------------------------------------------------------------------


def split_signal(name: str) -> tuple[str, str]:
    """``"log.contains: x"`` -> (``log.contains``, ``x``); a registered name -> (name, '')."""
    head, _, value = name.partition(":")
    return (head, value.strip()) if head in WORDING and value.strip() else (name, "")


def describe(name: str, registry: Mapping[str, Signal] = SIGNALS) -> str:
    name = name.strip()
    if name in registry:
        return registry[name].description
    head, value = split_signal(name)
    return WORDING[head].format(value) if value else name


def described(name: Column, registry: Mapping[str, Signal] = SIGNALS) -> Column:
    """Column form of :func:`describe`: the registry's words, else those for head and value, else the name itself."""
    name = F.trim(name)
    known = F.create_map(*[F.lit(x) for n, s in registry.items() for x in (n, s.description)]) if registry else F.lit(None).cast("map<string,string>")
    wording = F.create_map(*[F.lit(x) for pair in WORDING.items() for x in pair])
    head, value = F.substring_index(name, ":", 1), F.trim(F.regexp_extract(name, "(?s)^[^:]*:(.*)$", 1))
    said = F.when(value != "", F.replace(F.try_element_at(wording, head), F.lit("{}"), value))
    return F.coalesce(F.try_element_at(known, name), said, name)
